"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a piece starts a suffix of at most four words. Words that are too rare end suffixes, since no phrase that
holds one can be frequent. Suffixes are routed by their language and two leading words, so all occurrences of a phrase meet in
one task, which sorts pointers to them word by word: a pivot's word splits a part into smaller, equal and greater; the
size of the equal part is the count of the phrase so far, and parts that are too small are abandoned at once.
Suffixes behind a pair of words that many rows begin with are routed by all their words instead; their counts are
parts, so nothing is abandoned there and sums over the tasks decide. The same holds for a task whose rows do not fit in
memory at once. Equal suffixes of a block are one row with a count before anything is shuffled.

Words travel as hashes of 48 bits, or 64 if those do not do. They are exact names here: a seed is taken under which no
frequent word shares its hash with any other word of its language, which is looked up in the counts of all words before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import drop, tidy
from quayside.session import written

DEPTH = 4
#: Bytes of text that a task takes apart at a time, and suffixes that it sorts at a time.
BLOCK, SORTED = 6 << 20, 3 << 20
#: Occurrences a route should have, fewest routes, and the share of all that makes a pair of words hot.
ROUTE, ROUTES, HOT = 1 << 20, 64, 4096
#: Bits of the filter of frequent words. If it fills up, rare words pass too and are abandoned later.
FILTER = 1 << 26
SMALL = 1 << 15
#: Routes of a block that leave a task together.
SENT = 32


def rows_of(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))


class Words:
    """The words of a block of texts: ``code`` per occurrence, ``piece`` it lies in, ``names`` and ``langs`` by code."""

    def __init__(self, langs, texts):
        import numpy as np
        import pyarrow as pa

        lengths = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kinds, lower = _kinds()
        kind = kinds[data]
        inside = kind == 0
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        if inside[0]:
            starts = np.concatenate([[0], starts])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        doc = np.searchsorted(np.cumsum(lengths + 1), starts, "right")
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), starts).astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        body = lower[data[inside]]
        del data, kind, inside, starts, ends
        words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        words = words.dictionary_encode()
        names = pa.array(langs).dictionary_encode()
        n = max(1, len(words.dictionary))
        both = names.indices.to_numpy()[doc].astype(np.int64) * n + words.indices.to_numpy()
        every, self.code = _codes(both, n * max(1, len(names.dictionary)))
        self.names = words.dictionary.cast(pa.binary()).take(pa.array(every % n)) if len(every) else pa.array([], pa.binary())
        self.langs = names.dictionary.take(pa.array(every // n)) if len(every) else pa.array([], pa.string())


def hashes(langs, names, seed: int, width: int):
    """Hashes of (language, word) of ``width`` bytes, never 0."""
    import numpy as np

    def spread(values):
        """A weighted sum of each value's bytes; every place within a value has a weight of its own."""
        values = values.cast("large_binary")
        offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
        if len(values) == 0 or offsets[-1] == offsets[0]:
            return np.zeros(len(values), np.uint64)
        data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64) + np.uint64(1)
        lengths = np.diff(offsets)
        place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
        weights = np.random.default_rng(seed).integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * (weights[place % 1024] + place.astype(np.uint64)), dtype=np.uint64)])
        at = offsets - offsets[0]
        return (sums[at[1:]] - sums[at[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + lengths.astype(np.uint64)

    mixed = spread(names) ^ (spread(langs) * np.uint64(0xBF58476D1CE4E5B9))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.maximum((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(64 - 8 * width), np.uint64(1))


def _codes(keys, span: int):
    """(distinct keys, index of each key among them)."""
    import numpy as np

    if span <= 8 * len(keys) + (1 << 16):
        seen = np.zeros(span, bool)
        seen[keys] = True
        every = np.flatnonzero(seen)
        place = np.zeros(span, np.int32)
        place[every] = np.arange(len(every), dtype=np.int32)
        return every, place[keys]
    every, code = np.unique(keys, return_inverse=True)
    return every, code.astype(np.int32)


def _kinds():
    """By byte: 0 within words, 1 between words, 2 between pieces; and the byte with A-Z lower-cased."""
    import numpy as np

    kinds, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    kinds[[0x20, 0x09]] = 1
    kinds[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
    lower[65:91] += 32
    return kinds, lower


def _blocks(batches):
    """Words of about ``BLOCK`` bytes of texts at a time; a text is never cut."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_buffer().to_pybytes() if hasattr(text, "as_buffer") else text.as_py()
            langs.append(lang)
            texts.append(text)
            size += len(text)
            if size >= BLOCK:
                yield Words(langs, texts)
                langs, texts, size = [], [], 0
    if texts:
        yield Words(langs, texts)


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, phrase, f, pair): occurrences of every word, and those of pairs that are many in some block, as found there."""
    hot = HOT

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for w in _blocks(batches):
            if not len(w.code):
                continue
            yield _counted(w.langs, w.names, np.bincount(w.code, minlength=len(w.names)), False)
            first = np.flatnonzero(w.piece[1:] == w.piece[:-1])
            pairs = np.sort(w.code[first].astype(np.int64) * len(w.names) + w.code[first + 1])
            at = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.array([], int)
            n = np.diff(np.append(at, len(pairs)))
            at, n = at[n * hot >= len(w.code)], n[n * hot >= len(w.code)]
            a, b = pairs[at] // len(w.names), pairs[at] % len(w.names)
            names = [x + b" " + y for x, y in zip(w.names.take(pa.array(a)).to_pylist(), w.names.take(pa.array(b)).to_pylist())]
            yield _counted(w.langs.take(pa.array(a)), pa.array(names, pa.binary()), n, True)

    def _counted(langs, names, n, pair):
        import numpy as np
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([langs, names, pa.array(n.astype(np.int64)), pa.array(np.full(len(n), pair))],
                                          ["lang", "phrase", "f", "pair"])

    found = rows.mapInArrow(run, "lang string, phrase binary, f long, pair boolean")
    return found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "pair").agg(F.sum("f").alias("f"))


def named(words: DataFrame, least: int) -> tuple[DataFrame, int, int]:
    """The words (lang, phrase, f) that occur ``least`` times with their hash ``h``; the seed and width they are exact under."""
    for width in (6, 8):
        for seed in range(4):
            def run(batches, seed=seed, width=width):
                import numpy as np
                import pyarrow as pa

                for batch in batches:
                    h = hashes(batch.column("lang"), batch.column("phrase").cast("binary"), seed, width).view(np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h)], [*batch.schema.names, "h"])

            hashed = written(words.select("lang", "phrase", "f").mapInArrow(run, "lang string, phrase string, f long, h long"), "named")
            shared = hashed.groupBy("lang", "h").agg(F.count("*").alias("n"), F.max("f").alias("f")).filter(f"n > 1 AND f >= {least}")
            if shared.isEmpty():
                return hashed.filter(F.col("f") >= least), seed, width
            drop(words.sparkSession, hashed)
    raise RuntimeError("every seed gives a frequent word and another one of its language one 64-bit hash")


def frequent_filter(frequent: DataFrame):
    """A bitmap of the hashes of frequent words; at most ``FILTER`` bits, however many words there are."""
    import numpy as np

    h = F.pmod("h", F.lit(FILTER))
    longs = frequent.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(FILTER >> 6, np.uint64)
    bitmap[longs.column("at").to_numpy()] = longs.column("bits").to_numpy().view(np.uint64)
    return bitmap


def partition(columns, pointers, weights, least: int):
    """(pointer, words, count) of every prefix of 2 to ``DEPTH`` words that has ``least`` occurrences.

    Multikey three-way quicksort: ``columns`` are the words of each suffix by depth (0: it has ended), ``pointers`` the
    suffixes. Short parts are sorted at once instead of being split on.
    """
    import numpy as np

    out = []
    todo = [(pointers, 0)]
    while todo:
        part, depth = todo.pop()
        if weights[part].sum() < least:
            continue
        if len(part) <= SMALL:
            _finish(columns, part, depth, weights, least, out)
            continue
        words = columns[depth][part]
        pivot = np.partition(words, len(words) // 2)[len(words) // 2]
        todo += [(part[words < pivot], depth), (part[words > pivot], depth)]
        equal = part[words == pivot]
        if pivot == 0:
            continue
        n = int(weights[equal].sum())
        if n < least:
            continue
        if depth:
            out.append((equal[:1], np.array([depth + 1]), np.array([n])))
        if depth + 1 < len(columns):
            todo.append((equal, depth + 1))
    if not out:
        return tuple(np.array([], np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out))


def _finish(columns, part, depth: int, weights, least: int, out: list) -> None:
    """The same for a short part whose suffixes agree in their first ``depth`` words."""
    import numpy as np

    order = part[np.lexsort([c[part] for c in columns[depth:][::-1]])]
    sums = np.concatenate([[0], np.cumsum(weights[order])])
    new = np.zeros(len(order), bool)
    new[0] = True
    for d in range(depth, len(columns)):
        words = columns[d][order]
        new[1:] |= words[1:] != words[:-1]
        at = np.flatnonzero(new)
        n = sums[np.append(at[1:], len(order))] - sums[at]
        keep = (n >= least) & (words[at] != 0)
        if d and keep.any():
            out.append((order[at[keep]], np.full(int(keep.sum()), d + 1), n[keep]))


def _combined(columns):
    """Equal rows of ``columns`` as one with its count, in order. -1 sorts first."""
    import numpy as np

    most = max(int(c.max()) for c in columns) + 2
    if most ** len(columns) < 1 << 63:
        key = np.zeros(len(columns[0]), np.int64)
        for c in columns:
            key = key * most + (c + 1)
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, counts = key[at], np.diff(np.append(at, len(key)))
        out = []
        for _ in columns:
            key, c = np.divmod(key, most)
            out.append((c - 1).astype(np.int32))
        return out[::-1], counts.astype(np.int64)
    wide = [c.astype(np.int64) for c in columns]
    order = np.lexsort([((a + 1) << 32) | (b + 1) for a, b in zip(wide[::2], wide[1::2])][::-1])
    columns = [c[order].astype(np.int32) for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order))).astype(np.int64)


def suffixes(rows: DataFrame, bitmap, seed: int, width: int, hot: set, routes: int, depth: int = DEPTH) -> DataFrame:
    """(route, lang, split, words, counts): a block's suffixes for one route, as arrays of numbers of ``width`` and 4 bytes.
    ``words`` has one column per depth of their words' hashes, 0 where a suffix has ended."""
    sent = rows.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bitmap, hot = sent.value
        for w in _blocks(batches):
            hashed = hashes(w.langs, w.names, seed, width)
            bit = hashed % np.uint64(FILTER)
            often = np.flatnonzero((bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
            place = np.full(len(hashed), -1, np.int32)
            place[often] = np.arange(len(often), dtype=np.int32)
            code, hashed = place[w.code], hashed[often]
            names, langs = w.names.take(pa.array(often)), w.langs.take(pa.array(often))
            first = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (w.piece[1:] == w.piece[:-1]))
            if not len(first):
                continue
            columns = [code[first], code[first + 1]]
            alive = np.ones(len(first), bool)
            for d in range(2, depth):
                at = np.minimum(first + d, len(code) - 1)
                alive &= (first + d < len(code)) & (code[at] >= 0) & (w.piece[at] == w.piece[first])
                columns.append(np.where(alive, code[at], -1))
            columns, counts = _combined(columns)
            split = _is_hot(langs, names, columns, hot)
            mixed = _mix(_mix(np.zeros(len(counts), np.uint64), hashed[columns[0]]), hashed[columns[1]])
            if split.any():
                for c in columns[2:]:
                    mixed = np.where(split, _mix(mixed, hashed[c] + np.uint64(1) + (c < 0)), mixed)
            route = ((mixed >> np.uint64(20)) % np.uint64(routes)).astype(np.int64)
            lang = langs.dictionary_encode()
            lang_of = lang.indices.to_numpy()[columns[0]].astype(np.int64)
            key = (lang_of * routes + route) * 2 + split
            by = np.argsort(key, kind="stable")
            hashed = np.append(hashed, np.uint64(0))  # the last place is for -1
            words = np.stack([hashed[c[by]] for c in columns]).view(np.uint8).reshape(depth, -1, 8)[:, :, :width]
            counts, key = counts[by].astype(np.uint32), key[by]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(cuts[1:], len(by))
            for i in range(0, len(cuts), SENT):
                at, end = cuts[i:i + SENT], ends[i:i + SENT]
                yield pa.RecordBatch.from_pydict({
                    "route": pa.array(key[at] // 2 % routes), "lang": lang.dictionary.take(pa.array(key[at] // 2 // routes)),
                    "split": pa.array(key[at] % 2 == 1),
                    "words": pa.array([words[:, a:b].tobytes() for a, b in zip(at, end)], pa.binary()),
                    "counts": pa.array([counts[a:b].tobytes() for a, b in zip(at, end)], pa.binary())})
            del words, counts, key, columns, hashed, by, mixed, route, split, lang_of, w
            tidy()

    def _is_hot(langs, names, columns, hot):
        """Which suffixes begin with a hot pair. The pairs' words are looked up in the block, not the other way round."""
        import numpy as np

        place = {key: i for i, key in enumerate(zip(langs.to_pylist(), names.to_pylist()))} if hot else {}
        known = [(place.get((lang, a)), place.get((lang, b))) for lang, pair in hot for a, b in [pair.split(b" ")]]
        pairs = np.array([a * len(names) + b for a, b in known if a is not None and b is not None], np.int64)
        return np.isin(columns[0].astype(np.int64) * len(names) + columns[1], pairs)

    def _mix(h, x):
        import numpy as np

        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    return rows.mapInArrow(run, "route long, lang string, split boolean, words binary, counts binary")


def phrase_counts(routed: DataFrame, frequent: DataFrame, width: int, least: int, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase, f, words) of all phrases of 2 to ``depth`` words that occur ``least`` times. ``routed`` comes route by
    route; one with more than ``SORTED`` suffixes is counted in parts."""
    limit = SORTED

    def run(batches):
        held, n, parts, route = [], 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["route"] != route or n >= limit:
                    if held:
                        yield from _sorted(held, least if parts == 0 and row["route"] != route else 1)
                    parts = parts + 1 if row["route"] == route else 0
                    held, n, route = [], 0, row["route"]
                held.append(row)
                n += len(row["counts"]) // 4
        if held:
            yield from _sorted(held, 1 if parts else least)

    def _sorted(held, least):
        """With ``least`` 1 there are other parts elsewhere, so nothing is abandoned; split rows always have some."""
        for split in (False, True):
            for lang in sorted({r["lang"] for r in held}):
                some = [r for r in held if r["lang"] == lang and r["split"] == split]
                if some:
                    yield _one(lang, some, 1 if split else least)
        tidy()

    def _one(lang, some, least):
        import numpy as np
        import pyarrow as pa

        weights = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in some]).astype(np.int64)
        whole = np.zeros((depth, len(weights), 8), np.uint8)
        at = 0
        for r in some:
            part = np.frombuffer(r["words"], np.uint8).reshape(depth, -1, width)
            whole[:, at:at + part.shape[1], :width] = part
            at += part.shape[1]
        columns = list(whole.view(np.uint64)[:, :, 0])
        at, size, n = partition(columns, np.arange(len(weights), dtype=np.int32), weights, least)
        flat = np.stack([c[at] for c in columns]).T[np.arange(depth) < size[:, None]].view(np.int64)
        codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), codes, pa.array(n.astype(np.int64))], ["lang", "codes", "f"])

    found = routed.mapInArrow(run, "lang string, codes array<long>, f long")
    counted = found.groupBy("lang", "codes").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return spelt(written(counted, "counted"), frequent)


def spelt(counted: DataFrame, frequent: DataFrame) -> DataFrame:
    """Phrases in words instead of hashes."""
    each = counted.select("lang", "codes", "f", F.posexplode("codes").alias("i", "h"))
    each = each.join(frequent.select("lang", "h", F.col("phrase").alias("word")), ["lang", "h"])
    words = F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])
    return each.groupBy("lang", "codes", "f").agg(words.alias("w")).select(
        "lang", F.array_join("w", " ").alias("phrase"), "f", F.size("w").alias("words"))


def scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """``phrases`` with l, r and score of their lowest-scoring cut. ``parts`` (lang, part, f) holds every part of them.

    The score is floor(2000000 a / (l + r)) in decimals of 38 digits, so products may pass 64 bits.
    """
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "words", "f", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "f", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(part), F.col("f").alias(name)), ["lang", part])
    exact = "cast(2000000 AS decimal(7,0)) * cast(f AS decimal(19,0)) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))"
    lowest = F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "words", "f").agg(lowest.alias("x")).select("lang", "phrase", "words", "f", "x.*")


def outdone(phrases: DataFrame) -> DataFrame:
    """(lang, phrase) of phrases within a longer one that occurs at least 0.8 times as often.

    A phrase is at most as frequent as those within it, so a longer one matters only if one by one word does.
    """
    w = F.split("phrase", " ")
    longer = phrases.filter("words > 2").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "),
        F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer_f"))
    both = phrases.join(most, ["lang", "phrase"])
    return both.filter(F.expr("cast(longer_f AS decimal(20,0)) * 100 >= cast(f AS decimal(20,0)) * 80")).select("lang", "phrase")


def collocations(df: DataFrame, least: int = 30, top: int | None = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank from 1, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to 4 words (None: all).

    a is how often the phrase occurs within pieces, l and r how often the two parts of its lowest-scoring cut do, n the
    words of the language; phrases with a < ``least`` do not count, nor those that a longer one outdoes. Order: score
    falling, a falling, phrase by its bytes. A null language is ``und``; null and empty texts have no words, repeated rows count
    again, very long texts are taken whole, one at a time; other columns are left out. An empty table gives no rows.
    """
    rows = rows_of(df, text_col, lang_col)
    counts = written(word_counts(rows), "words")
    single = counts.filter("NOT pair")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    n = totals.agg(F.sum("n")).first()[0] or 0
    frequent, seed, width = named(single, least)
    hot = {(r["lang"], r["phrase"].encode()) for r in counts.filter("pair").filter(F.col("f") * HOT >= n).collect()}
    routes = max(ROUTES, n // ROUTE)
    routed = suffixes(rows, frequent_filter(frequent), seed, width, hot, routes).repartition(routes, "route").sortWithinPartitions("route")
    phrases = written(phrase_counts(routed, frequent, width, least), "phrases")
    parts = frequent.select("lang", F.col("phrase").alias("part"), "f").union(
        phrases.filter(f"words < {DEPTH}").select("lang", "phrase", "f"))
    kept = phrases.join(outdone(phrases), ["lang", "phrase"], "left_anti")
    made = scored(kept, parts).withColumnRenamed("f", "a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    made = made.withColumn("rank", F.row_number().over(order))
    if top is not None:
        made = made.filter(F.col("rank") <= top)
    return made.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
