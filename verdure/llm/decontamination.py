"""Benchmark items in documents, also with other numbers, names and units.

Texts become templates: numbers, quantities (a number with its unit) and names turn into typed placeholders, which keep
their values as slots; other words are literal, in lower case and without punctuation around them. Windows of template
tokens are hash-joined between documents and benchmark. A run of windows on one diagonal counts only if its slots are
consistent: a value of the item must stand for the same value of the document wherever it occurs in the run. Where a
diagonal has conflicts it is cut into maximal consistent runs; windows whose slots are unchanged always count.

Names are told by their capitals, so every text has a second, folded form without names: all words in lower case, with
placeholders for numbers alone. It finds copies in other case. Items shorter than a window are looked for whole, by
their folded words.

A window needs ``size // 2`` literal tokens to be compared as a template; with fewer its slot values are part of the
key, so that texts full of numbers or names match where they are the same.

Only windows that a bitmap of the benchmark's keys lets through leave the tasks. The bitmap has a fixed size; whatever
it lets through wrongly falls out in the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import wordhash
from verdure.llm.bitmaps import bitmap_of, may_hold, passes
from verdure.session import materialize

# Words for numbers (without those that are articles too) and units that make a number a quantity, in
# English, German, French and Spanish.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta cien mil"
).split()
UNITS = (
    "% percent mm cm m km meter meters metre metres kilometer kilometers inch inches foot feet ft yard yards mile miles "
    "mg g kg gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "$ € £ dollar dollars cent cents euro euros mph km/h m/s hz khz mhz ghz v volt volts w watt watts kw j joule joules "
    "degree degrees °c °f k b kb mb gb tb "
    "prozent stunde stunden minuten sekunde sekunden tag tage woche wochen monat monate jahr jahre "
    "heure heures jour jours semaine semaines mois ans mètre mètres hora horas día días semana semanas mes meses año años metro metros"
).split()

_LITERAL, _NUMBER, _QUANTITY, _NAME = range(4)
_PLACEHOLDERS = wordhash.mix(np.arange(7001, 7005, dtype=np.uint64))
_TRIMMED = np.isin(np.arange(256), [ord(c) for c in "!\"#&'()*,-./:;<=>?@[\\]^_`{|}~+"])
_DIGIT = np.isin(np.arange(256), [*range(48, 58)])
_JOINER = np.isin(np.arange(256), [ord(c) for c in ".,:/-"])
_MEASURE = re.compile(rb"[$\xe2\x82\xac\xc2\xa3]*([0-9][0-9.,:/-]*)(.*)", re.S)
# Text worked on at once: the work arrays take about 85 bytes a byte of it, and every core of an executor has its own.
SLICE_BYTES = 1 << 20
LEAST_TEMPLATE = 5  # tokens from which an item shorter than a window is looked for as a template too
_FORMS = {"template": wordhash.mix(np.uint64([71]))[0], "folded": wordhash.mix(np.uint64([72]))[0]}


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.sort(wordhash.words(pc.utf8_lower(pa.array(words))).hashes)


_NUMBER_HASHES, _UNIT_HASHES = _word_hashes(NUMBER_WORDS), _word_hashes(UNITS)


def _is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


class Words:
    """Words of a batch of texts with what does not depend on the form: bounds, folded hashes, numbers and capitals."""

    def __init__(self, texts: pa.Array):
        w = wordhash.words(texts)
        n = len(w.begin)
        row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        data = w.data
        # words without punctuation around them; what is left of a word may be nothing
        index = np.arange(len(data) + 1)
        solid = np.append(~_TRIMMED[data], True)
        right = np.minimum.accumulate(np.where(solid, index, len(data) + 1)[::-1])[::-1]
        left = np.maximum.accumulate(np.where(solid, index, -1))
        begin = np.minimum(right[w.begin], w.end)
        end = np.maximum(left[w.end - 1] + 1, begin) if n else w.end
        words = _gathered(data, begin, end)
        folded = np.zeros(n, np.uint64)
        full = end > begin
        folded[full] = wordhash.words(pc.utf8_lower(words)).hashes
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        joiners = np.concatenate([[0], np.cumsum(_JOINER[data])])
        n_digits = digits[end] - digits[begin]
        kind = np.full(n, _LITERAL)
        kind[(n_digits > 0) & (n_digits + joiners[end] - joiners[begin] == end - begin)] = _NUMBER
        kind[full & _is_in(folded, _NUMBER_HASHES)] = _NUMBER
        for i in np.flatnonzero((n_digits > 0) & (kind == _LITERAL)):
            match = _MEASURE.fullmatch(data[begin[i] : end[i]].tobytes())
            if match and (not match[2] or match[2].decode(errors="replace").lower() in UNITS):
                kind[i] = _QUANTITY
        # a capital inside a sentence makes a name
        lead = np.append(data, [0, 0])[begin] if n else data[:0]
        second = np.append(data, [0, 0])[begin + 1] if n else data[:0]
        capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        stops = np.isin(data, [ord(c) for c in ".!?:\n"])
        stop_count = np.concatenate([[0], np.cumsum(stops)])
        opening = np.ones(n, bool)
        opening[1:] = (row[1:] != row[:-1]) | (stop_count[w.begin[1:]] > stop_count[np.maximum(end[:-1], w.begin[:-1])])
        self.n, self.row, self.text_first = n, row, w.first
        self.full, self.folded, self.kind, self.capital, self.opening = full, folded, kind, full & capital, opening


class Templates:
    """Template tokens of a batch of texts. Text ``i`` has the tokens ``first[i]:first[i + 1]``.

    ``codes`` are the literal hashes or placeholders, ``slots`` the hash of a placeholder's value, 0 for a literal. The
    folded form has no names.
    """

    def __init__(self, words: Words | pa.Array, form: str = "template"):
        words = words if isinstance(words, Words) else Words(words)
        n, row, full, folded, opening = words.n, words.row, words.full, words.folded, words.opening
        self.form, kind = form, words.kind.copy()
        if form == "template":
            kind[words.capital & ~opening & (kind == _LITERAL)] = _NAME
            # the first word of a sentence belongs to a name that goes on after it
            ahead = np.append((kind[1:] == _NAME) & ~opening[1:], False)[:n]
            kind[words.capital & opening & (kind == _LITERAL) & ahead] = _NAME
        # a unit right after a number makes one quantity of the two; names in a row make one name
        unit = full & _is_in(folded, _UNIT_HASHES) & (kind == _LITERAL)
        same_row = np.zeros(n, bool)
        same_row[1:] = row[1:] == row[:-1]
        before = np.concatenate([[-1], kind[:-1]])
        joined_unit = unit & same_row & (before == _NUMBER)
        kind[np.flatnonzero(joined_unit) - 1] = _QUANTITY
        joined_name = (kind == _NAME) & same_row & (before == _NAME)
        lone = ~full  # punctuation alone is no token
        head = ~(joined_unit | joined_name | lone)
        at = np.flatnonzero(head)
        values = np.where(kind == _LITERAL, 0, folded)
        values[joined_unit] = folded[joined_unit]
        values = wordhash.mix(values) * (values != 0)
        slots = np.add.reduceat(values, at) if len(at) else values[:0]
        self.codes = np.where(kind == _LITERAL, folded, _PLACEHOLDERS[kind])[at]
        self.slots = np.where(kind[at] == _LITERAL, np.uint64(0), slots | np.uint64(1))
        self.first = np.concatenate([[0], np.cumsum(head)])[words.text_first]

    def windows(self, size: int, exact_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, start, key)`` of all windows of ``size`` tokens; ``start`` counts from the text's first token.

        With ``exact_only`` slot values belong to all keys.
        """
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        at = wordhash._ranges(self.first[:-1], counts)
        literal = np.concatenate([[0], np.cumsum(self.slots == 0)])
        keys = wordhash.windows(self.codes, size)[at]
        few = (literal[at + size] - literal[at] < size // 2) | exact_only
        if few.any():
            exact = wordhash.windows(wordhash.mix(self.codes ^ self.slots), size)[at]
            keys = np.where(few, exact, keys)
        row = np.repeat(np.arange(len(counts)), counts)
        return row, at - self.first[row], wordhash.mix(keys + np.uint64(size) + _FORMS[self.form])


def _template_slices(batch: pa.RecordBatch, forms: Iterable[str]) -> Iterator[tuple[pa.RecordBatch, dict[str, Templates]]]:
    """The batch in slices of bounded text, each with its templates."""
    for part in wordhash.slices(batch, "text", SLICE_BYTES):
        words = Words(part.column("text"))
        yield part, {form: Templates(words, form) for form in forms}


def _gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as one text each; empty ranges are left out."""
    full = end > begin
    length = (end - begin)[full]
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    chosen = data[wordhash._ranges(begin[full], length)]
    return pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(chosen))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 8, coverage: float = 0.5, enough: int = 13, least_words: int = 2
) -> DataFrame:
    """``digest, item_id, covered, item_tokens, changed`` for every text of ``docs(text)`` that holds an item.

    ``digest`` is the MD5 of the text, so equal texts are judged once. An item of ``benchmark(item_id, text)`` is held
    if in one of its two forms (see above) consistent windows cover ``enough`` of its tokens, or the share ``coverage``
    of them. Items of under ``size`` tokens are looked for whole: by their folded words if they have ``least_words`` of
    them, and from 5 tokens as a template too. ``changed`` is the number of the item's slot values that the document
    replaces. The row is that of the form with the greater covered share, the template's if they agree. Equal item
    texts count as one item with the smallest item_id; items with null id or text, null and empty documents give no
    rows.
    """
    items = benchmark.where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))

    def item_windows(batches):
        for batch in batches:
            words = Words(batch.column("text"))
            ids = batch.column("item_id").cast(pa.int64()).to_numpy()
            for form in _FORMS:
                t = Templates(words, form)
                counts = np.diff(t.first)
                least = LEAST_TEMPLATE if form == "template" else least_words
                for length in np.unique(np.minimum(counts, size)):
                    if length < least:
                        continue
                    row, start, key = t.windows(int(length), form == "folded" and length < size)
                    own = (counts[row] >= size) if length == size else counts[row] == length
                    row, start, key = row[own], start[own], key[own]
                    yield _window_batch(t, row, start, key, int(length), {"item_id": pa.array(ids[row]), "tokens": pa.array(counts[row])})

    fields = "form string, start long, length int, key long, slots array<long>"
    listed = materialize(items.mapInArrow(item_windows, f"item_id long, tokens long, {fields}"), "benchmark")
    kinds = sorted((r[0], r[1]) for r in listed.select("form", "length").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(listed, "key"))

    def document_windows(batches):
        for batch in batches:
            for part, forms in _template_slices(batch, dict(kinds)):
                for form, length in kinds:
                    row, start, key = forms[form].windows(length, form == "folded" and length < size)
                    hit = passes(shared.value, key)
                    row, start, key = row[hit], start[hit], key[hit]
                    if len(row):
                        yield _window_batch(forms[form], row, start, key, length, {"digest": part.column("digest").take(pa.array(row))})

    texts = docs.where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    seen = texts.mapInArrow(document_windows, f"digest string, {fields}")
    seen = seen.dropDuplicates(["digest", "form", "start", "length"])
    theirs = listed.withColumnsRenamed({"start": "item_start", "slots": "item_slots"})
    hits = seen.join(theirs, ["key", "form", "length"]).withColumn("diagonal", F.col("start") - F.col("item_start"))
    hits = materialize(hits.drop("key", "start"), "hits")

    place = ["digest", "item_id", "form", "diagonal"]
    pairs = hits.select(*place, F.explode(F.arrays_zip("item_slots", "slots")).alias("pair")).where("pair.item_slots <> 0")
    values = pairs.groupBy(*place, F.col("pair.item_slots").alias("value")).agg(
        F.min("pair.slots").alias("low"), F.max("pair.slots").alias("high")
    )
    runs = values.groupBy(*place).agg(
        F.max(F.col("low") != F.col("high")).alias("mixed"), F.sum((F.col("low") != F.col("value")).cast("int")).alias("changed")
    )
    judged = materialize(hits.join(runs, place, "left"), "judged")
    clean = judged.where("not coalesce(mixed, false)").select(*place, "item_start", "length", "tokens", F.coalesce("changed", F.lit(0)).alias("changed"))
    # a diagonal has no more windows than the item has tokens
    cut = judged.where("mixed").groupBy(*place).applyInArrow(
        _consistent_windows,
        "digest string, item_id long, form string, diagonal long, item_start long, length int, tokens long, changed long",
    )
    spans = clean.unionByName(cut).groupBy("digest", "item_id", "form").agg(
        F.array_sort(F.collect_set("item_start")).alias("starts"),
        F.first("length").alias("length"),
        F.first("tokens").alias("item_tokens"),
        F.max("changed").alias("changed"),
    )
    steps = F.transform("starts", lambda s, i: F.least(F.coalesce(F.get("starts", i + 1) - s, F.col("length")), F.col("length").cast("long")))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)
    spans = spans.select("digest", "item_id", "form", covered.alias("covered"), "item_tokens", F.col("changed").cast("long").alias("changed"))
    held = spans.where((F.col("covered") >= enough) | (F.col("covered") >= coverage * F.col("item_tokens")))
    share = F.struct(F.col("covered") / F.col("item_tokens"), F.col("form"))
    best = held.groupBy("digest", "item_id").agg(F.max_by(F.struct("covered", "item_tokens", "changed"), share).alias("best"))
    return best.select("digest", "item_id", "best.*")


def _consistent_windows(group: pa.Table) -> pa.Table:
    """Of one diagonal with conflicts the windows of the consistent run that covers most, and those without a change.

    A run takes windows in order until one gives a value of the item another meaning; the windows that share the older
    meaning leave the run then, so that every maximal run is met. Windows that contradict themselves belong to none.
    """
    starts = group.column("item_start").to_numpy()
    order = np.argsort(starts, kind="stable")
    length = group.column("length")[0].as_py()
    windows = []  # start, its changes, whether it contradicts itself
    theirs, own = group.column("item_slots").to_pylist(), group.column("slots").to_pylist()
    for i in order:
        meaning: dict[int, int] = {}
        sound = True
        for value, found in zip(theirs[i], own[i]):
            if value and meaning.setdefault(value, found) != found:
                sound = False
        windows.append((int(starts[i]), meaning, sound))
    plain = {w[0] for w in windows if w[2] and all(a == b for a, b in w[1].items())}
    best: tuple[int, list] = (-1, [])
    run: list = []
    for window in windows:
        if not window[2]:
            continue
        against = [k for k, w in enumerate(run) if any(w[1].get(v, m) != m for v, m in window[1].items())]
        if against:
            run = run[against[-1] + 1 :]
        run.append(window)
        covered = _covered(sorted(plain | {w[0] for w in run}), length)
        if covered > best[0]:
            best = (covered, list(run))
    chosen = sorted(plain | {w[0] for w in best[1]})
    changes = {(v, m) for w in best[1] for v, m in w[1].items() if v != m}
    row = {c: group.column(c)[0].as_py() for c in ("digest", "item_id", "form", "diagonal")}
    tokens = group.column("tokens")[0].as_py()
    n = len(chosen)
    columns = {c: [v] * n for c, v in row.items()}
    columns |= {"item_start": chosen, "length": [length] * n, "tokens": [tokens] * n, "changed": [len(changes)] * n}
    kinds = {"digest": pa.string(), "form": pa.string(), "length": pa.int32()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()})


def _covered(starts: list[int], length: int) -> int:
    """Tokens in windows that begin at the ascending ``starts``."""
    return sum(min(b - a, length) for a, b in zip(starts, starts[1:])) + (length if starts else 0)


def _window_batch(t: Templates, row, start, key, length: int, extra: dict) -> pa.RecordBatch:
    at = t.first[row] + start
    slots = t.slots[at[:, None] + np.arange(length)].ravel().view(np.int64)
    offsets = pa.array(np.arange(len(row) + 1, dtype=np.int32) * length)
    columns = extra | {
        "form": pa.array([t.form] * len(row), pa.string()),
        "start": pa.array(start),
        "length": pa.array(np.full(len(row), length, np.int32)),
        "key": pa.array(key.view(np.int64)),
        "slots": pa.ListArray.from_arrays(offsets, pa.array(slots)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``doc_id, item_id, covered, item_tokens, changed`` per row of ``docs(doc_id, text)`` and item that it holds."""
    named = docs.where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return named.join(contamination(docs, benchmark, **settings), "digest").drop("digest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns; null and empty texts stay.

    A bitmap of fixed size tells most rows that hold none; they are not shuffled. Whatever it lets through is joined.
    """
    held = materialize(contamination(docs, benchmark, **settings).select("digest").distinct(), "held")
    # whatever the columns of the input are called, they are carried along as one
    carried = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    perhaps = may_hold(held, "digest")
    free = carried.where(~perhaps)
    checked = carried.where(perhaps).join(held, "digest", "left_anti").select("row", "digest")
    return free.unionByName(checked).select("row.*")
