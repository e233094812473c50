"""Jaccard self-join of documents on their word n-gram sets through prefix trees.

1. Every text becomes its set of n-gram hashes. Equal sets form a class, and only classes go on, so copies are never
   paired with each other.
2. A global order puts rare n-grams first: by frequency level, then by hash. Levels come from a count sketch over all
   documents, whose size is fixed (``CELLS`` bytes at the driver). Any order gives the same links; a good one keeps
   frequent passages out of the prefixes.
3. Linked sets of ``n`` elements share one of their first ``n - ceil(t * n) + 1`` elements and have sizes within the
   threshold of each other. The prefixes are dealt by element once and read as a sorted stream, which holds one row at
   a time; elements that the sketch counts more than ``HOT`` times are salted. Classes that share an element at a
   compatible size are then compared by profile (their elements counted by hash range, whose differences add up to no
   more than those of the sets). Large sets have prefixes longer by ``l - 1`` and share ``l`` elements of them if they
   are linked. What passes connects the classes to candidate groups.
4. Each group is joined in a task that stores its sets in a trie. The overlaps of all query sets with a trie path are
   counted once for everything below the path; a subtree is left as soon as no query set can still reach the
   threshold with the elements that remain. Groups above ``TILE`` elements are cut into chunks, and one task joins
   each pair of chunks. A task returns one row per set: its number of links and a representative of its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm import wordhash
from verdure.llm.bitmaps import bitmap_of, passes
from verdure.llm.components import components
from verdure.session import discard, materialize

CELLS = 1 << 20  # counters of the sketch, one byte each at the driver
TILE = 1 << 19  # n-grams of one chunk of a candidate group
HOT = 1 << 20  # documents of an element from which its prefix entries are dealt to several tasks
_SALTS = 64
_RANGES = 64  # counts of a profile
LARGE = 1024  # elements from which several shared prefix elements are asked for
_BLOCK = 1 << 14


def jaccard_join(docs: DataFrame, words: int = 3, numerator: int = 9, denominator: int = 10) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links, n_copies`` for every row of ``docs(doc_id, text)``.

    Two rows link when ``denominator * |A & B| >= numerator * |A | B|`` for their sets of distinct ``words``-word
    shingles (A-Z lower-cased); a text with fewer words is one shingle. ``component_id`` is the smallest doc_id
    reachable by links, ``n_links`` the number of rows linked directly, ``n_copies`` the rows with the same set.
    A null or empty text has no shingle and is linked with nothing; its component is its own id. Rows with a null
    doc_id stay alone and have a null component. Repeated rows count as rows. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    levels = docs.sparkSession.sparkContext.broadcast(_frequency_levels(docs, words))

    def sets_of(batches):
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                values, bounds = _sets(part.column("text"), words)
                sizes = np.diff(bounds)
                prefix, ends = _prefixes(values, bounds, levels.value, numerator, denominator)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(sizes),
                        _signatures(values, bounds),
                        _profiles(values, bounds),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(prefix.view(np.int64))),
                    ],
                    ["doc_id", "n_shingles", "sig", "profile", "prefix"],
                )

    sets = docs.mapInArrow(sets_of, "doc_id long, n_shingles long, sig binary, profile binary, prefix array<long>")
    wide = materialize(sets, "sets")
    classes = (
        wide.where("doc_id is not null and n_shingles > 0")
        .groupBy("sig")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count("*").alias("copies"),
            F.first("n_shingles").alias("n"),
            F.first("profile").alias("profile"),
            F.first("prefix").alias("prefix"),
        )
    )
    classes = materialize(classes, "classes")
    # prefixes and profiles take most of the disk, and are deleted as soon as nothing reads them any more
    sets = materialize(wide.drop("prefix", "profile"), "ids")
    discard(wide)
    pairs = _candidates(classes, levels, numerator, denominator)
    groups = components(pairs)
    wide, classes = classes, materialize(classes.drop("prefix", "profile"), "counts")
    discard(pairs, wide)
    members = materialize(classes.withColumn("node", _short("sig")).join(groups, "node").drop("node"), "members")
    linked = materialize(_join_groups(docs, members, words, numerator, denominator), "links")
    discard(members)
    roots = components(linked.select(F.col("sig").alias("a"), F.col("peer").alias("b")))
    found = linked.groupBy("sig").agg(F.sum("links").alias("links")).join(roots.withColumnRenamed("node", "sig"), "sig")
    lead = found.join(classes.select("sig", "first_id"), "sig").groupBy("root").agg(F.min("first_id").alias("lead"))
    found = found.join(lead, "root").select("sig", "links", "lead")
    classes = classes.select("sig", "first_id", "copies").join(found, "sig", "left")
    classes = classes.select(
        "sig",
        F.coalesce("lead", "first_id").alias("lead"),
        "copies",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )
    grouped = sets.where("doc_id is not null and n_shingles > 0").join(classes, "sig")
    alone = sets.where("doc_id is null or n_shingles = 0")
    return grouped.select(
        "doc_id",
        "n_shingles",
        F.col("lead").alias("component_id"),
        F.col("links").alias("n_links"),
        F.col("copies").alias("n_copies"),
    ).unionByName(
        alone.select(
            "doc_id",
            "n_shingles",
            F.col("doc_id").alias("component_id"),
            F.lit(0).cast("long").alias("n_links"),
            F.lit(1).cast("long").alias("n_copies"),
        )
    )


def _sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    return wordhash.sorted_sets(*wordhash.shingles(wordhash.words(texts, lower=True), words))


def _signatures(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """128 bits that stand for the whole set of each document."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
            out[full, k] = np.add.reduceat(wordhash.mix(values ^ np.uint64(salt)), bounds[:-1][full])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(out), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _profiles(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """How many elements of each set fall into each of ``_RANGES`` hash ranges; counts stop at 65535."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # bits that neither the order of the prefixes nor the sketch uses
    cell = doc * _RANGES + ((values >> np.uint64(20)) % np.uint64(_RANGES)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=(len(bounds) - 1) * _RANGES), 65535).astype("<u2")
    return pa.array([c.tobytes() for c in counts.reshape(-1, _RANGES)], pa.binary())


def _cells(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(44)).astype(np.int64)


def _frequency_levels(docs: DataFrame, words: int) -> np.ndarray:
    """A level per sketch cell, four per doubling of the n-gram count. Summed by block in Spark."""

    def count(batches):
        seen = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in wordhash.slices(batch, "text"):
                values, _ = _sets(part.column("text"), words)
                seen += np.bincount(_cells(values), minlength=CELLS).astype(np.uint32)
        for block in range(CELLS // _BLOCK):
            own = seen[block * _BLOCK : (block + 1) * _BLOCK]
            if own.any():
                yield pa.RecordBatch.from_pydict({"block": [block], "counts": [own.tobytes()]})

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(block, np.zeros(_BLOCK, np.uint64))
                own += np.frombuffer(counts, np.uint32)
        for block, counts in sums.items():
            level = np.floor(4 * np.log2(1.0 + counts)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": [block], "level": [level.tobytes()]})

    blocks = docs.select("text").mapInArrow(count, "block long, counts binary").repartition(16, "block")
    levels = np.zeros(CELLS, np.uint8)
    counted = materialize(blocks.mapInArrow(total, "block long, level binary"), "levels")
    for row in counted.collect():
        levels[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.level, np.uint8)
    discard(counted)
    return levels


def _least_shared(n: np.ndarray) -> np.ndarray:
    """Prefix elements that linked sets share: one, or more for large sets, whose prefixes are longer by the rest."""
    return np.where(n < LARGE, 1, 1 + n // 64)


def _prefixes(values, bounds, levels, numerator, denominator):
    sizes = np.diff(bounds)
    keep = np.minimum(sizes - -(-numerator * sizes // denominator) + _least_shared(sizes), sizes)
    ends = np.concatenate([[0], np.cumsum(keep)])
    out = np.zeros(int(ends[-1]), np.uint64)
    level = levels[_cells(values)]
    for i in np.flatnonzero(keep):
        a, b = bounds[i], bounds[i + 1]
        out[ends[i] : ends[i + 1]] = values[a:b][np.argsort(level[a:b], kind="stable")[: keep[i]]]
    return out, ends


def _short(sig: str) -> Column:
    """64 bits of a signature. Equal ones only make candidate groups larger."""
    return F.conv(F.hex(F.substring(sig, 1, 8)), 16, -10).cast("long")


def _candidates(classes: DataFrame, levels, numerator: int, denominator: int) -> DataFrame:
    """Edges, written, that connect all classes which share a prefix element and may be linked by size and profile.

    Sizes fall into bands one threshold wide, so linked sets lie in the same band or in neighbouring ones. Classes with
    a hot element are connected without a look at their profiles.
    """
    width = float(np.log(denominator / numerator) * 1.0001)

    def post(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            tokens = prefix.flatten().to_numpy().view(np.uint64)
            node, band = (np.repeat(batch.column(c).to_numpy(), np.diff(prefix.offsets.to_numpy())) for c in ("node", "band"))
            hot = levels.value[_cells(tokens)] > 4 * np.log2(HOT)
            salt = np.where(hot, 1 + (node & (_SALTS - 1)), 0).astype(np.int32)
            columns = [pa.array(tokens.view(np.int64)), pa.array(salt), pa.array(band), pa.array(node)]
            yield pa.RecordBatch.from_arrays(columns, ["token", "salt", "band", "node"])

    band = F.floor(F.log("n") / width).cast("int").alias("band")
    named = classes.withColumn("node", _short("sig"))
    postings = named.select("node", band, "prefix").mapInArrow(post, "token long, salt int, band int, node long")
    dealt = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "band", "node")
    shared = materialize(dealt.mapInArrow(_shared, "token long, band int, a long, b long"), "shared")
    hot = shared.where("b is not null").select("a", "b")

    def compare(batches):
        parts = [[*(c.to_numpy() for c in b.columns[:4]), _counts(b.column("profile"))] for b in batches]
        if parts:
            pairs = _alike(*(np.concatenate(c) for c in zip(*parts)), numerator, denominator)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs], ["a", "b", "need"])

    cold = shared.where("b is null").select("token", "band", F.col("a").alias("node"))
    cold = cold.join(named.select("node", "n", "profile"), "node").select("token", "band", "node", "n", "profile")
    alike = cold.repartition("token").mapInArrow(compare, "a long, b long, need long")
    alike = alike.groupBy("a", "b").agg(F.min("need").alias("need"), F.count("*").alias("n")).where("n >= need")
    pairs = materialize(hot.unionByName(alike.select("a", "b")).distinct(), "candidates")
    discard(shared)
    return pairs


def _shared(batches):
    """Rows of a stream sorted by element, salt, band and class that have a neighbour at a compatible size.

    A row of an ordinary element comes back as ``(token, band, a)``. For a salted one there is an edge ``(a, b)`` to a
    node of the element and each pair of neighbouring bands. The last row is carried from batch to batch.
    """
    carried, known = None, False
    for batch in batches:
        token, salt, band, node = (c.to_numpy() for c in batch.columns)
        if len(token) == 0:
            continue
        told = np.zeros(len(token), bool)
        if carried is not None:
            token, salt, band, node = (np.concatenate([[x], c]) for x, c in zip(carried, (token, salt, band, node)))
            told = np.append(known, told)
        close = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (band[1:] - band[:-1] <= 1)
        near = np.append(close, False)
        near[1:] |= close
        own = np.flatnonzero((near | (salt > 0)) & ~told)
        plain, hot = own[salt[own] == 0], own[salt[own] > 0]
        hot = np.repeat(hot, 2)
        meet = token[hot].view(np.uint64) + band[hot].astype(np.uint64) + np.tile([0, 1], len(hot) // 2).astype(np.uint64)
        none = np.arange(len(plain) + len(hot)) < len(plain)
        columns = [
            pa.array(token[np.append(plain, hot)]),
            pa.array(band[np.append(plain, hot)]),
            pa.array(node[np.append(plain, hot)]),
            pa.array(np.append(np.zeros(len(plain), np.int64), wordhash.mix(meet).view(np.int64)), mask=none),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["token", "band", "a", "b"])
        carried, known = (token[-1], salt[-1], band[-1], node[-1]), bool(near[-1] or salt[-1] > 0)


def _counts(profiles: pa.Array) -> np.ndarray:
    """The profiles of a column as rows of counts."""
    raw = np.frombuffer(b"".join(profiles.to_pylist()), "<u2")
    return raw.reshape(-1, _RANGES)


def _alike(token, band, node, n, profile, numerator, denominator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``a, b, need`` whose sizes and profiles allow a link, element by element.

    A pair counts once it has ``need`` elements. Of more than 32 classes with an element only as many pairs come back
    as connect them, and these count at once.
    """
    order = np.lexsort((node, band, token))
    token, band, node, n, profile = (x[order] for x in (token, band, node, n, profile))
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (band[1:] - band[:-1] > 1)
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(token)))
    run = np.repeat(np.arange(len(start)), size)

    def allowed(x, y):
        apart = np.abs(profile[x].astype(np.int32) - profile[y]).sum(axis=-1)
        fit = (numerator + denominator) * apart <= (denominator - numerator) * (n[x] + n[y])
        return fit & (denominator * np.minimum(n[x], n[y]) >= numerator * np.maximum(n[x], n[y]))

    left, right, need = [node[:0]], [node[:0]], [node[:0]]
    small = np.repeat(size <= 32, size)
    for step in range(1, 32):
        at = np.flatnonzero(small[:-step] & (run[:-step] == run[step:])) if step < len(run) else start[:0]
        if len(at) == 0:
            break
        for part in np.array_split(at, len(at) // 8192 + 1):
            part = part[allowed(part, part + step)]
            left.append(np.minimum(node[part], node[part + step]))
            right.append(np.maximum(node[part], node[part + step]))
            need.append(np.minimum(_least_shared(n[part]), _least_shared(n[part + step])))
    for a, count in zip(start[size > 32], size[size > 32]):
        label = np.arange(count)
        for k in range(count - 1):
            rest = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
            near = rest[allowed(a + k, a + rest)] if len(rest) else rest
            if len(near):
                # one pair for each part that gets connected
                parts, first = np.unique(label[near], return_index=True)
                left.append(np.minimum(node[a + k], node[a + near[first]]))
                right.append(np.maximum(node[a + k], node[a + near[first]]))
                need.append(np.ones(len(parts), np.int64))
                label[np.isin(label, parts)] = label[k]
    return np.concatenate(left), np.concatenate(right), np.concatenate(need)


def _join_groups(docs: DataFrame, members: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """``sig, peer, links`` per class and task: the links found there and a class of the same component."""
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("chunks"))
    members = members.join(sizes, "root").select(
        F.col("first_id").alias("doc_id"),
        "sig",
        "root",
        "copies",
        "chunks",
        F.expr("cast(pmod(xxhash64(sig), chunks) as int)").alias("chunk"),
    )

    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(members.select(F.xxhash64("doc_id").alias("h")), "h"))

    def load(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column("h").to_numpy().view(np.uint64))))
            for part in wordhash.slices(batch, "text"):
                values, bounds = _sets(part.column("text"), words)
                blobs = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                columns = [part.column("doc_id").cast(pa.int64()), _signatures(values, bounds), blobs]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sig", "grams"])

    # sets are many times larger than members, which grow with the input: never the one to broadcast.
    # a repeated doc_id may bring other texts along, so the signature has to agree too
    known = docs.where("doc_id is not null").withColumn("h", F.xxhash64(F.col("doc_id").cast("long")))
    loaded = known.mapInArrow(load, "doc_id long, sig binary, grams binary").join(members.hint("merge"), ["doc_id", "sig"])
    tiles = loaded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "root",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
        "sig",
        "copies",
        "chunk",
        "grams",
    )

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig, first = np.unique(np.array(table["sig"].to_pylist(), object), return_index=True)
        table = table.take(pa.array(first))
        sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        copies = table["copies"].to_numpy()
        chunk, i, j = table["chunk"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        left = np.flatnonzero(chunk == i)
        right = left if i == j else np.flatnonzero(chunk == j)
        links, label = trie_join(sets, left, right, copies, numerator, denominator)
        peer = [sig[k] for k in label]
        return pa.table({"sig": pa.array(list(sig), pa.binary()), "peer": pa.array(peer, pa.binary()), "links": links})

    return tiles.groupBy("root", "i", "j").applyInArrow(join, "sig binary, peer binary, links long")


def trie_join(sets, left, right, weight, numerator, denominator) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sets at ``left`` (queries) and at ``right`` (stored in the trie), given as distinct sets.

    Returns for every set the summed weight of its partners and the smallest index connected to it. Elements that many
    of the sets hold come first in the trie, so that near copies share long paths.
    """
    if len(left) == 0 or len(right) == 0:
        return np.zeros(len(sets), np.int64), np.arange(len(sets))
    whole, part = numerator + denominator, numerator
    elements, rank = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(rank)
    place = np.empty(len(elements), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(elements))
    ends = np.cumsum([len(s) for s in sets])
    ranks = [np.sort(r) for r in np.split(place[rank], ends[:-1])]
    size = np.array([len(s) for s in sets])

    query_size = size[left]
    held = np.concatenate([ranks[q] for q in left])
    owner = np.repeat(np.arange(len(left)), query_size)[np.argsort(held, kind="stable")]
    start = np.searchsorted(np.sort(held), np.arange(len(elements) + 1))

    stored = sorted(right, key=lambda k: ranks[k].astype(">u4").tobytes())
    shared = np.zeros(len(stored), np.int64)  # elements in common with the set before
    for k in range(1, len(stored)):
        a, b = ranks[stored[k - 1]], ranks[stored[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        shared[k] = differ[0] if len(differ) else m
    stored_size = size[stored]

    links = np.zeros(len(sets), np.int64)
    label = np.arange(len(sets))
    stack = [(0, len(stored), 0, np.zeros(len(left), np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        # the path that all sets of this subtree share
        reach = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else int(stored_size[lo])
        least, most = int(stored_size[lo:hi].min()), int(stored_size[lo:hi].max())
        path = ranks[stored[lo]][depth:reach]
        if len(path):
            lengths = start[path + 1] - start[path]
            overlap = overlap + np.bincount(owner[wordhash._ranges(start[path], lengths)], minlength=len(left))
        # the overlap can still grow by what remains of the longest set below; sizes must fit the shortest one
        alive = denominator * most >= part * query_size + whole * (reach - overlap)
        alive &= denominator * query_size >= part * least
        if not alive.any():
            continue
        if stored_size[lo] == reach:
            own = stored[lo]
            hit = left[alive & (whole * overlap >= part * (query_size + reach))]
            hit = hit[hit != own]
            if len(hit):
                links[own] += weight[hit].sum()
                if left is not right:
                    links[hit] += weight[own]
                met = np.unique(label[np.append(hit, own)])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            lo += 1
        cuts = [lo, *(k for k in range(lo + 1, hi) if shared[k] == reach), hi]
        stack.extend((a, b, reach, overlap) for a, b in zip(cuts[:-1], cuts[1:]) if b > a)
    return links, label
