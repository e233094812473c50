"""The pipeline on whole small tables, against the same stages done one document at a time."""

from __future__ import annotations

import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from test_quality_rules import brute as quality_brute
from test_quality_rules import chosen
from tokenizers import Tokenizer

import corpus_pipeline
from verdure.llm.decontamination import contaminated_documents
from verdure.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = False


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def kept_of_near_duplicates(rows):
    """Ids of the documents that are the smallest of their group of linked ones."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 10 >= 8 * max(len(x), len(y)) and 10 * len(x & y) >= 8 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i for i in ids if root(i) == i}


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_order_of_the_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "tokens"]


def test_every_stage_against_single_documents(spark):
    docs = table(spark, "documents")
    verdicts = {r[0]: r[-1] for r in quality_brute(rows_of(docs), chosen(table(spark, "labels")))}

    good = STAGES["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    assert rows_of(good) == [r for r in rows_of(docs) if verdicts[r[0]]]

    alone = STAGES["near_duplicates"](spark, good, SF)
    kept = kept_of_near_duplicates(rows_of(good))
    assert alone.columns == docs.columns and rows_of(alone) == [r for r in rows_of(good) if r[0] in kept]

    clean = STAGES["decontaminate"](spark, alone, SF)
    held = {r.doc_id for r in contaminated_documents(alone, table(spark, "benchmark")).collect()}
    items = [r.text for r in table(spark, "benchmark").collect()]
    verbatim = {i for i, t in rows_of(alone) if any(x in t for x in items)}
    assert verbatim <= held and rows_of(clean) == [r for r in rows_of(alone) if r[0] not in held]

    mixed = STAGES["mix"](spark, clean, SF)
    assert mixed.columns == docs.columns
    count = {}
    for r in rows_of(mixed):
        count[r] = count.get(r, 0) + 1
    assert set(count) <= set(rows_of(clean)) and max(count.values()) <= 2
    words = lambda rows: sum(len(WORD.findall(t or "")) for _, t in rows)
    longest = max(words([r]) for r in rows_of(clean))
    sources = clean.select("source").distinct().count()
    assert abs(words(rows_of(mixed)) - 1.5 * words(rows_of(clean))) <= sources * longest

    files = STAGES["tokens"](spark, mixed, SF)
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in files.collect())
    ids = [(i, [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows_of(mixed)]
    assert got == sorted((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    starts = sorted((r.start, r.n_tokens) for r in files.collect())
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_a_run_is_the_stages_one_after_the_other(spark):
    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    once = [sorted(map(tuple, x.select("doc_id", "n_tokens", "ids_crc32").collect())) for x in (docs, corpus_pipeline.run(spark, SF))]
    assert once[0] == once[1]


NAMES = [
    "kept", "score", "buckets", "words", "hashes", "held_digest", "digest", "copy", "size", "copies", "taken", "target", "source_size",
    "component_id", "n_shingles", "document", "row", "sig", "key", "part", "start", "removed_key",
]


def odd_rows():
    prose = " ".join(f"the word number {i} of a long and plain text" for i in range(12))
    rows = [
        (1, prose, "s"), (1, prose, "s"), (2, prose + " x", "s"), (3, None, "s"), (4, "", None), (None, prose, None), (None, None, None),
        (5, "short", "t"), (6, "y" * 60_000 + " " + " ".join(f"w{i}" for i in range(30_000)), "t"), (7, " \n ", ""),
        (8, " ".join(f"other{i}" for i in range(80)), "u"), (8, " ".join(f"different{i}" for i in range(80)), "u"),
    ]
    return [(i, t, "en", s, len(t or ""), *range(len(NAMES))) for i, t, s in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_come_through_whatever_they_are_called(spark, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES)
    docs = spark.createDataFrame(odd_rows(), schema).repartition(3)
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns
    got, given = [tuple(r) for r in out.collect()], odd_rows()
    assert got and set(got) <= set(given)
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0
    # rows without text or id are neither lost nor made to fail by the stages that do not judge them
    if name in ("near_duplicates", "decontaminate"):
        assert sum(r[1] is None for r in got) == 2 and sum(r[0] is None for r in got) == 2
    if name == "near_duplicates":
        assert sum(r[0] == 1 for r in got) == 2 and not any(r[0] == 2 for r in got)


def test_the_last_stage_takes_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in NAMES)
    docs = spark.createDataFrame(odd_rows(), schema)
    out = STAGES["tokens"](spark, docs, SF)
    assert out.count() == docs.count()
    assert STAGES["tokens"](spark, docs.limit(0), SF).count() == 0


def scratch(spark):
    """Names of the tables in the scratch folder."""
    folder = Path(scratch_path(spark, "x")).parent
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_near_duplicates_leaves_no_large_table_behind(spark):
    before = scratch(spark)
    STAGES["near_duplicates"](spark, table(spark, "documents"), SF).collect()
    left = [name.rsplit("-", 1)[0] for name in scratch(spark) - before]
    assert not {"levels", "sets", "classes", "shared", "candidates", "members"} & set(left)
    assert left.count("star") <= 2  # the last round of each call of components


def test_near_duplicates_with_repeated_and_null_ids_of_any_integer_type(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text + " x"), (2, text + " x"), (2, "something else"), (3, "alone here"), (None, text), (None, None), (4, None)]
    for kind in ("int", "long"):
        docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        got = STAGES["near_duplicates"](spark, docs, SF)
        assert got.schema == docs.schema
        assert rows_of(got) == sorted([rows[0], *rows[4:]], key=repr)
