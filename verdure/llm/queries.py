"""The registered queries of this subpackage, each over a whole table, and the SQL that gives their answers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from verdure.catalog.registry import query
from verdure.llm.bpe_codec import decode_ids, encode_texts
from verdure.llm.decontamination import contaminated_documents
from verdure.llm.lexical_search import lexical_search
from verdure.llm.line_dedup import line_decisions
from verdure.llm.mixing import mix_sources
from verdure.llm.ngram_join import jaccard_join
from verdure.llm.quality_rules import quality_rules
from verdure.llm.substring_dedup import substring_dedup
from verdure.llm.token_counts import token_counts
from verdure.llm.token_files import read_token_files, write_token_files
from verdure.llm.url_filter import url_verdicts
from verdure.llm.warc import captures, write_warc
from verdure.llm.whitening import fit_whitening, quantised, whiten

BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
RANKS_50K = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = rf"""
with recursive w as (select doc_id, {_WORDS.format(text=_FOLDED)} as words from documents),
s as (
  select doc_id, unnest(list_distinct(
    case when len(words) >= 3 then list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2])
         when len(words) > 0 then [array_to_string(words, ' ')] else [] end)) as shingle
  from w),
c as (select doc_id, count(*) as n from s group by doc_id),
-- documents with equal sets share a digest; only one of each goes into the pairs
k as (select doc_id, string_agg(shingle, chr(10) order by shingle) as whole from s group by doc_id),
r as (select doc_id, min(doc_id) over (partition by md5(whole)) as rep from k),
u as (select s.doc_id, s.shingle, c.n from s join c using (doc_id) join r using (doc_id) where r.rep = r.doc_id),
p as (
  select a.doc_id as x, b.doc_id as y from u a join u b on a.shingle = b.shingle and a.doc_id < b.doc_id
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 190 * count(*) >= 90 * (a.n + b.n)),
e as (select x, y from p union select y, x from p),
reach as (select doc_id as x, doc_id as y from u group by doc_id union select reach.x, e.y from reach join e on reach.y = e.x)
select d.doc_id, coalesce(c.n, 0)::bigint as n_shingles, coalesce(m.component, d.doc_id)::bigint as component_id
from documents d left join c using (doc_id) left join r using (doc_id)
left join (select x, min(y) as component from reach group by x) m on m.x = r.rep
"""


@query("op1_ngram_jaccard_join", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_join(docs, words=3, numerator=90, denominator=100).select("doc_id", "n_shingles", "component_id")


_OP2 = r"""
with s as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f as (
  select s.page_id, h || p as rule, v, row_number() over (partition by s.page_id order by length(h || p) desc, length(h) desc) as k
  from s join r on (s.host = h or s.host like '%.' || h) and starts_with(s.path, p))
select s.page_id, s.host, s.path, f.rule, coalesce(f.v, 'allow') as verdict
from s left join f on f.page_id = s.page_id and f.k = 1
"""


@query("op2_url_filter", _OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


@query("op3_benchmark_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against planted and re-parameterised items."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated_documents(docs, benchmark)


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the tokenizers library."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), BPE_50K, limit=512)


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a comparison of all pairs of lines."""
    return line_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the tokenizers library."""
    files = read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), BPE_50K, end_id=0))
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_OP7 = rf"""
with w as (select doc_id, {_WORDS.format(text="coalesce(text, '')")} as words from documents),
x as (select doc_id, words, unnest(range(1, greatest(len(words) - 11, 1))) as i from w),
y as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as win from x),
z as (select doc_id, i, min(doc_id) over (partition by win) as first_doc from y),
g as (select distinct doc_id, unnest(range(i, i + 13)) as k from z where first_doc < doc_id),
t as (select doc_id, words, unnest(range(1, len(words) + 1)) as k from w),
a as (
  select t.doc_id, count(g.k) as n_removed, string_agg(words[t.k], ' ' order by t.k) filter (where g.k is null) as kept
  from t left join g on g.doc_id = t.doc_id and g.k = t.k group by t.doc_id)
select w.doc_id, len(w.words)::bigint as n_words, coalesce(a.n_removed, 0)::bigint as n_removed, sha256(coalesce(a.kept, '')) as kept_sha256
from w left join a using (doc_id)
"""


@query("op7_substring_dedup", _OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=13)
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_words", "n_removed", digest)


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the same scores computed text by text."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(docs.select("doc_id", "text"), labels).select(*columns)


_OP9 = """
with d as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select *, min(page_id) over (partition by digest) as first_id from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when n >= 100 and first_id < page_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and first_id < page_id then first_id end as refers_to
from f
"""


@query("op9_warc", _OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    response = F.col("response")
    return captures(manifest, with_payload=False).select(
        "page_id",
        response["payload_bytes"].alias("payload_bytes"),
        response["payload_digest"].alias("payload_digest"),
        response["type"].alias("record_type"),
        "refers_to",
    )


# the preference of short texts and its scale repeat the operator's arithmetic, so that ranks agree to the last bit
_OP10 = rf"""
with d as (
  select doc_id, source, len({_WORDS.format(text="coalesce(text, '')")})::bigint as size,
    md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as key from documents),
l as (select *, case when size < 20 then 0.5::double else 1::double end as pref,
    (('0x' || substr(key, 1, 12))::bigint::double + 0.5) / 281474976710656::double as u from d),
s as (select source, sum(size)::bigint as source_size,
    sum(case when pref = 1 then size else 0 end)::double as n1, sum(case when pref = 0.5 then size else 0 end)::double as n2 from l group by source),
o as (select *, 2::double * source_size as cap,
    [3::double, 1::double, 2::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from s),
v as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over f, 0)) / (sum(w) over () - coalesce(sum(w) over f, 0)) as lev,
    row_number() over (order by cap / w, source nulls last) as place
  from o window f as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select *, coalesce(least(cap, w * (select arg_min(lev, place) from v where cap / w > lev)), cap) as target from v),
c as (select *, case when source_size = 0 then 0 when n1 > 0 and target / (n1 + n2 / 2) < 2 then target / (n1 + n2 / 2)
    when n2 > 0 and (target - 2 * n1) / (n2 / 2) * 0.5 < 2 then (target - 2 * n1) / (n2 / 2) else 4 end as scale from t),
e as (select l.*, c.source_size, c.target, least(2, c.scale * l.pref) as e from l join c on l.source is not distinct from c.source),
q as (select *, floor(e) as whole, e - floor(e) as part from e),
k as (select *, case when part > 0 then u / (1 - u) / (part / (1 - part)) end as odds from q),
z as (select *, case when part > 0 then odds / (1 + odds) end as rank, target - sum(whole * size) over (partition by source) as need from k),
y as (select *, sum(size) over (partition by source, rank is null order by rank, key) as upto from z)
select doc_id, size, source_size, target,
  ((whole + case when rank is not null and upto - size / 2 <= need then 1 else 0 end) * size)::bigint as taken
from y
"""


@query("op10_mixing", _OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("size") < 20, 0.5)
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), preference=short)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op11_bpe_codec")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against the tiktoken library."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    decoded = decode_ids(encode_texts(docs, RANKS_50K, public_tokenizers.PATTERN), RANKS_50K)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a dense eigensolver over the collected vectors of a small table."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", step=256)
    model = fit_whitening(vectors, components=4)
    if model is None:
        return vectors.selectExpr(
            "key as vec_id", "0 as component", "0L as n", "0L as deviation", "0d as whitened", "0d as explained", "0d as identity_error"
        ).where("false")
    explained = F.array(*[F.lit(e).cast("double") for e in model.explained])
    each = whiten(vectors, model).select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("key").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, "at").alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


_TERMS = r"regexp_extract_all({folded}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP13 = rf"""
with d as (select row_number() over () as r, doc_id, unnest({_TERMS.format(folded=_FOLDED)}) as term from documents),
i as (
  select item_id, term, count(*) as c
  from (select item_id, unnest({_TERMS.format(folded=_FOLDED)}) as term from (select distinct item_id, text from benchmark))
  group by all),
n as (select r, doc_id, count(*)::bigint as n from d group by all),
t as (select count(*)::bigint as nn, sum(n)::bigint as l from n),
f as (select r, term, count(*)::bigint as tf from d where term in (select term from i) group by all),
w as (select term, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, t group by term, nn),
s as (
  select i.item_id, n.doc_id, f.r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * nn) // l)))))::bigint as score
  from i join f using (term) join w using (term) join n using (r), t group by all),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""


@query("op13_lexical_search", _OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search(docs, benchmark, k=10)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
