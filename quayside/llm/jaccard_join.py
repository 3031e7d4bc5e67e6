"""Documents linked by the Jaccard similarity of their word shingles, by T-occurrence search.

Two sets of x and y shingles reach the similarity just when they share T(x, y) of them. Ordering every set by one order
of all shingles, rare ones first, two such sets share one of their first few (the lists that DivideSkip calls
short); the others are long lists, which are only probed. The steps:

1. Read the texts: a set's size, a 64-bit name of the set, and a parity sketch. Equal sets are one node from here on.
   Shingles that occur often are counted on the way; being known as frequent only moves a shingle to the end
   of the order, so the result does not depend on how well they are counted.
2. Read the texts again: first shingles to buckets. Nodes that meet in a list of a few entries and can still reach T, by
   their sizes and by their places in the order, are candidates. In a longer list all meet its smallest node first, which
   is one for nearly all lists of a group of copies; later, among what is then not yet in one component, the rest.
   So candidates grow with the lists' entries, not with the pairs of a group.
3. The sketches give a lower bound on the symmetric difference and drop most false candidates.
4. What is left is counted exactly: short lists by a heap merge, long ones by binary probes. A query's set is sent once for
   every ``SPOKES`` partners, theirs once per candidate.
5. Connected components of the links.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import components, drop, free_shuffles, slices, text_bytes, total_bytes
from quayside.session import written

NULL_LAST = (1 << 63) - 1
SLICE, BUCKET_BYTES, GATHER = 4 << 20, 2 << 20, 2_000_000
FREQUENT, MOST_FREQUENT, LONG_LIST, SPOKES, TURNS = 16, 1 << 19, 4, 64, 4
SKETCH_BITS, FOLD = 2048, 16
#: Lists of more entries go through the rounds of centers before their rest is paired.
ROUND_LIST = 32
#: Wanted keys that are broadcast, 8 bytes each.
MOST_WANTED = 1 << 20
MULTIPLIER, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
ENTRY = [("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("rank", "<u4")]


def shingle_sets(texts: list[bytes], k: int) -> list:
    """Sorted 64-bit hashes of the distinct shingles of each text: k words in a row, lower-cased in ASCII, or all of a
    text's words if there are fewer."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    # The words of all texts, which line feeds hold apart, one after another.
    data = np.frombuffer(b"\n".join([*texts, b""]).lower(), np.uint8)
    space = np.zeros(256, bool)
    space[list(b"\t\n\x0b\x0c\r ")] = True
    solid = np.zeros(len(data) + 1, bool)
    np.logical_not(space[data], out=solid[1:])
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
    # Each word is looked up by its bytes and hashed once.
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(places), pa.py_buffer(data[solid[1:]])]).dictionary_encode()
    _, at, distinct = found.dictionary.buffers()
    at, distinct = np.frombuffer(at, np.int64, len(found.dictionary) + 1).tolist() if len(starts) else [], bytes(distinct or b"")
    once = np.fromiter((xxhash.xxh3_64_intdigest(distinct[s:e]) for s, e in zip(at, at[1:])), np.uint64, len(found.dictionary))
    a = once[found.indices.to_numpy()]
    begin = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)]))
    del data, solid, starts, ends, places, found, at, distinct

    def hashed(a, width):
        n = len(a) - width + 1
        h = np.full(n, width, np.uint64)
        for i in range(width):
            h = h * np.uint64(MULTIPLIER) + a[i:i + n]
            h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(31)
        return h

    h, out = hashed(a, k) if len(a) >= k else np.empty(0, np.uint64), []
    for s, e in zip(begin.tolist(), begin[1:].tolist()):
        tokens = h[s:e - k + 1] if e - s >= k else hashed(a[s:e], e - s) if e > s else np.empty(0, np.uint64)
        tokens.sort()
        out.append(tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens)
    return out


def name_of(tokens, seed: int = 0) -> tuple[int, int]:
    """Two independent 63-bit names of a set."""
    import xxhash

    data = tokens.tobytes()
    return xxhash.xxh3_64_intdigest(data, seed) >> 1, xxhash.xxh64_intdigest(data) >> 1


def sketch_of(tokens) -> bytes:
    """Bit i is the parity of how many shingles fall into cell i: cells in which two sketches differ hold at least one
    shingle each that only one of the sets has."""
    import numpy as np

    cells = np.bincount((tokens & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes) -> list[int]:
    """A sketch with its cells laid upon each other, as ``FOLD`` whole numbers: their parities add up, so cells in which two
    of them differ hold at least one shingle each that only one of the sets has, too."""
    import numpy as np

    return np.bitwise_xor.reduce(np.frombuffer(sketch, "<i8").reshape(-1, FOLD), axis=0).tolist()


class Similarity:
    """inter / union >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, x, y):
        """T: how many shingles two sets of these sizes have to share."""
        return -((-self.num * (x + y)) // (self.num + self.den))

    def first(self, n):
        """How many shingles in the common order a set has to show to meet every set it is linked to."""
        return n + (-self.num * n) // self.den + 1

    def band(self, n: str, turn: int) -> str:
        """SQL for a number that sets have in common when their sizes allow them to be linked, or else most often in the next
        turn, whose bands lie half a band off."""
        return f"floor(ln({n}) / {math.log(self.den / max(self.num, 1)) or 1.0} + {turn} / 2)"

    def ordered(self, tokens, frequent):
        """The first shingles of a set, rare ones before frequent ones, and how many of them are rare."""
        import numpy as np

        p = self.first(len(tokens))
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        common = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
        rare = tokens[~common][:p]
        return np.concatenate([rare, tokens[common][:p - len(rare)]]), len(rare)


def divide_skip(query: list[int], sets: list[list[int]], needed: list[int]) -> list[int]:
    """Numbers of the sorted sets that share at least ``needed`` shingles with the sorted query.

    Every shingle of the query has a list of the sets that hold it. With T the smallest need, T - 1 lists, the longest
    ones, are left aside: a set that reaches T is in one of the others, which a heap merges. What a set
    still lacks is probed in its own sorted shingles, until it has enough or can no longer get it.
    """
    if not sets:
        return []
    lists: dict[int, list[int]] = {t: [] for t in query}
    for number, tokens in enumerate(sets):
        for t in tokens:
            if t in lists:
                lists[t].append(number)
    by_length = sorted(query, key=lambda t: len(lists[t]))
    short = len(query) - (min(needed) - 1)
    if short <= 0:
        return []
    found: dict[int, int] = {}
    for number in heapq.merge(*(lists[t] for t in by_length[:short])):
        found[number] = found.get(number, 0) + 1
    out = []
    for number, count in found.items():
        tokens, left = sets[number], len(query) - short
        for t in by_length[short:]:
            if count >= needed[number] or count + left < needed[number]:
                break
            at = bisect_left(tokens, t)
            count += at < len(tokens) and tokens[at] == t
            left -= 1
        if count >= needed[number]:
            out.append(number)
    return sorted(out)


def groups(df: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
           text_col: str = "text", long_list: int = LONG_LIST, with_hash: bool = False, seed: int = 0) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (the smallest id reachable by links), and with
    ``with_hash`` text_sha256, where a null text counts as empty.

    Links join documents whose sets have inter / union >= num / den; a text without words, or null, has an empty set
    and no link. Equal sets are linked. Null ids count as larger than all others; a component of null ids only has
    a null component_id, and documents without links have their own id. Rows that repeat an id are documents of their
    own. Other columns are left out. An empty table gives no rows. Sets are told apart by 63-bit names; should two
    share one, all is done again with names from the next ``seed``.
    """
    spark, like = df.sparkSession, Similarity(num, den)
    buckets = total_bytes(df, text_col) // BUCKET_BYTES + 1
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_LAST)).alias("doc"),
                     F.col(id_col).isNull().alias("no_id"), text_bytes(text_col).alias("text"))
    sha = F.sha2("text", 256) if with_hash else F.lit(None).cast("string")
    docs = docs.withColumn("tag", F.md5("text")).withColumn("sha", sha)

    folds = [f"f{i}" for i in range(FOLD)]

    def profile(batches):
        import numpy as np
        import pyarrow as pa

        held, size, seen = [], 0, set()

        def often():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1].astype("<u4")
            for b, s, e in parts(tokens, buckets):
                yield {"kind": 1, "bucket": b, "tokens": tokens[s:e].tobytes(), "counts": counts[s:e].tobytes()}

        schema = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("no_id", pa.bool_()), ("tag", pa.string()), ("sha", pa.string()), ("n", pa.int64()),
                            ("node", pa.int64()), ("other", pa.int64()), ("sketch", pa.binary()),
                            ("bucket", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()), *((f, pa.int64()) for f in folds)])
        for whole in batches:
            for batch in slices(whole, SLICE):
                sets, rows = shingle_sets(batch.column("text").to_pylist(), words), []
                for doc, no_id, tag, sha, tokens in zip(*(batch.column(c).to_pylist() for c in ("doc", "no_id", "tag", "sha")), sets):
                    node, other = name_of(tokens, seed) if len(tokens) else (None, None)
                    rows.append({"kind": 0, "doc": doc, "no_id": no_id, "tag": tag, "sha": sha, "n": len(tokens), "node": node, "other": other,
                                 "sketch": sketch_of(tokens) if len(tokens) else None})
                    if len(tokens):
                        rows[-1] |= dict(zip(folds, folded(rows[-1]["sketch"])))
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        held.append(tokens)
                        size += len(tokens)
                if size > GATHER:
                    rows += often()
                    held, size, seen = [], 0, set()
                yield pa.RecordBatch.from_pylist(rows, schema)
        if held:
            yield pa.RecordBatch.from_pylist(list(often()), schema)

    first = written(docs.mapInArrow(profile, "kind int, doc long, no_id boolean, tag string, sha string, n long, node long, other long, "
                                    "sketch binary, bucket int, tokens binary, counts binary" + "".join(f", {f} long" for f in folds)), "profiles")
    seen_often = frequent_tokens(first)
    sent = spark.sparkContext.broadcast(seen_often)
    classes = written(first.filter("kind = 0 AND n > 0").groupBy("node").agg(
        F.min(F.struct("doc", "tag")).alias("rep"), F.min("other").alias("other"), F.max("other").alias("differs"), F.max("n").alias("n"),
        F.max("sketch").alias("sketch"), *[F.max(f).alias(f) for f in folds]), "nodes")
    if classes.filter("other != differs").count():
        drop(spark, first, classes)
        return groups(df, words, num, den, id_col, text_col, long_list, with_hash, seed + 1)

    def prefixes(batches):
        import numpy as np
        import pyarrow as pa

        frequent = sent.value
        for whole in batches:
            for batch in slices(whole, SLICE):
                rare, common, seen = [], [], set()
                for tokens in shingle_sets(batch.column("text").to_pylist(), words):
                    if not len(tokens):
                        continue
                    node = name_of(tokens, seed)[0]
                    if node in seen:
                        continue
                    seen.add(node)
                    some, split = like.ordered(tokens, frequent)
                    rows = np.empty(len(some), ENTRY)
                    rows["token"], rows["node"], rows["n"], rows["rank"] = some, node, len(tokens), np.arange(len(some))
                    rare.append(rows[:split])
                    common.append(rows[split:])
                if not rare:
                    continue
                rows = np.concatenate(rare)
                rows = rows[np.argsort(rows["token"])]
                out = [(b, rows[s:e].tobytes()) for b, s, e in parts(rows["token"], buckets)]
                rows = np.concatenate(common)
                if len(rows):
                    out.append((buckets + int(rows["node"][0] % buckets), rows.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary()))], ["bucket", "rows"])

    def meet(key, table):
        """Candidates from the short lists of a bucket; the entries of long lists as they are."""
        import numpy as np
        import pyarrow as pa

        rows = distinct_entries(np.concatenate([np.frombuffer(r, ENTRY) for r in table.column("rows").to_pylist()]))
        pairs = [np.empty((0, 2), np.int64)]
        if key[0].as_py() < buckets:
            token = rows["token"]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.repeat(np.diff(np.append(starts, len(rows))), np.diff(np.append(starts, len(rows))))
            short, rows = rows[(size > 1) & (size <= long_list)], rows[size > long_list]
            at = np.arange(len(short))
            for d in range(1, long_list):
                at = at[at + d < len(short)]
                at = at[short["token"][at] == short["token"][at + d]]
                if not len(at):
                    break
                x, y = short[at], short[at + d]
                ok = reach(like, x["n"].astype(np.int64), x["rank"], y["n"].astype(np.int64), y["rank"])
                pairs.append(np.stack([x["node"][ok], y["node"][ok]], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        a = pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "token": none, "n": none, "rank": none})
        b = pa.table({"a": rows["node"].astype(np.int64), "b": pa.nulls(len(rows), pa.int64()), "token": rows["token"].astype(np.int64),
                      "n": rows["n"].astype(np.int64), "rank": rows["rank"].astype(np.int64)})
        return pa.concat_tables([a, b])

    met = written(docs.select("text").mapInArrow(prefixes, "bucket int, rows binary").groupBy("bucket").applyInArrow(
        meet, "a long, b long, token long, n long, rank long"), "met")
    free_shuffles(spark)
    entries = met.filter("b IS NULL").select("token", F.col("a").alias("node"), "n", "rank").distinct()
    lists = written(entries.join(classes.select("node", *folds), "node"), "entries")
    center = lists.groupBy("token").agg(F.min(F.struct("node", "rank", "n", *folds)).alias("c"))
    near_sql = lambda *sides: f"{reach_sql(like, *sides[:4])} AND {near_by_sketch(like, *sides[:4:2], sides[4])}"
    spokes = lists.join(center, "token").filter("node != c.node").filter(near_sql("n", "rank", "c.n", "c.rank", "c.f"))
    near = met.filter("b IS NOT NULL").select("a", "b").union(spokes.select(F.least("node", "c.node"), F.greatest("node", "c.node")))
    links = verified(spark, docs, classes, near.distinct(), like, words)
    if not lists.isEmpty():
        # What the first center left apart in a very long list meets others, one per list, band of sizes and round; each round brings
        # groups together, so that few entries of a list still differ when at last all that do are paired. In shorter lists
        # an entry has no more than ``ROUND_LIST`` partners to begin with.
        many = written(lists.groupBy("token").count().filter(F.col("count") > ROUND_LIST).select("token"), "many")
        apart = written(picked(lists, "token", many), "lists")
        drop(spark, many)
        for turn in range(1, TURNS + 1):
            if apart.isEmpty():
                break
            known = labelled(apart, links)
            drop(spark, apart)
            apart = known
            known = known.withColumn("band", F.expr(like.band("n", turn)))
            drawn = F.struct(draw(turn).alias("draw"), "node", "rank", "n", "label", *folds)
            center = known.groupBy("token", "band").agg(F.min(drawn).alias("c"))
            spokes = known.join(center, ["token", "band"]).filter("label != c.label").filter(near_sql("n", "rank", "c.n", "c.rank", "c.f"))
            more = verified(spark, docs, classes, spokes.select(
                F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct(), like, words)
            if more.isEmpty():
                break
            links = links.union(more)
        known = labelled(lists, links)
        drop(spark, apart, lists)
        lists = known
        rest = paired(known, near_sql, folds).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
        links = links.union(verified(spark, docs, classes, rest, like, words))
    label = components(links)
    named = classes.select("node", F.col("rep.doc").alias("rep")).join(label.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = written(named.join(least, "component").select("node", "least"), "components")
    rows = first.filter("kind = 0").select("doc", "no_id", "n", "node", "sha")
    out = rows.join(named, "node", "left").select(
        F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("least", "doc"), F.lit(NULL_LAST)).alias("component_id"), *[F.col("sha").alias("text_sha256")] * with_hash)
    done = written(out, "groups")
    drop(spark, first, classes, met, lists, named)
    return done


def labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The entries of ``lists`` with the component that the links so far put their node in. Lists whose nodes are all in one
    component are left out: no link of theirs joins components any more."""
    label = components(links).withColumnRenamed("id", "node").withColumnRenamed("component", "label")
    known = lists.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = known.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most")
    tokens = written(mixed.select("token"), "mixed")
    done = written(picked(known, "token", tokens), "lists")
    drop(lists.sparkSession, tokens)
    return done


def draw(turn: int) -> Column:
    """What the center of a round is the smallest of. Rare shingles go first, so where the shingle of a list comes early in a
    set, the set has few of its own: it differs least from what the others have in common, and what is linked to
    any of them is mostly linked to it. Later rounds draw by lot."""
    return F.col("rank").cast("long") if turn <= 2 else F.xxhash64("node", F.lit(turn))


def paired(known: DataFrame, near_sql, folds: list[str]) -> DataFrame:
    """Pairs (x, node) of entries of one list that are in different components and near enough.

    One of the two is not in the component of the list's center; where neither is, the smaller node is x. Two sets whose
    last list before this one is the same met there, at earlier places, so they are no pair here.
    """
    center = known.groupBy("token").agg(F.min(F.struct("node", "label")).alias("c"))
    before = F.lag("token").over(Window.partitionBy("node").orderBy("rank"))
    known = known.withColumn("before", before).join(center, "token").withColumn("out", F.expr("label != c.label")).drop("c")
    outside = known.filter("out").select(
        "token", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("rank").alias("xr"), F.col("label").alias("xl"),
        F.col("before").alias("xbefore"), *[F.col(f).alias(f"x{f}") for f in folds])
    return outside.join(known, "token").filter(
        "label != xl AND (x < node OR NOT out) AND coalesce(before != xbefore, true)").filter(near_sql("n", "rank", "xn", "xr", "xf"))


def picked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key``, a long, is among those of ``wanted``, a written table of distinct ones. Up to ``MOST_WANTED`` are
    broadcast, so that for a few the many are not shuffled."""
    if wanted.count() <= MOST_WANTED:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, key, "left_semi")


def distinct_entries(rows):
    """Entries by token and node, each once. A node has one entry for a token. Whole numbers are sorted many times faster
    than rows."""
    import numpy as np

    rows = rows[np.lexsort((rows["node"], rows["token"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    return rows[new]


def parts(tokens, buckets: int):
    """(bucket, start, end) of the buckets that sorted tokens fall into, by their first 32 bits."""
    import numpy as np

    if not len(tokens):
        return
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    yield from zip(bucket[starts].tolist(), starts.tolist(), np.append(starts[1:], len(tokens)).tolist())


def frequent_tokens(first: DataFrame):
    """Sorted shingles seen at least ``FREQUENT`` times where slices had them more than once. There are at most
    ``MOST_FREQUENT`` of them (4 MB): the limit rises until that holds."""
    import numpy as np

    def total(key, table):
        import numpy as np
        import pyarrow as pa

        tokens = np.concatenate([np.frombuffer(t, "<u8") for t in table.column("tokens").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()])
        tokens, at = np.unique(tokens, return_inverse=True)
        counts = np.bincount(at, counts).astype(np.int64)
        keep = counts >= FREQUENT
        return pa.table({"token": tokens[keep].astype(np.int64), "rows": counts[keep]})

    counted = written(first.filter("kind = 1").select("bucket", "tokens", "counts").groupBy("bucket").applyInArrow(
        total, "token long, rows long"), "frequent")
    limit = FREQUENT
    while counted.filter(F.col("rows") >= limit).count() > MOST_FREQUENT:
        limit *= 2
    found = counted.filter(F.col("rows") >= limit).select("token").toArrow().column("token")
    drop(first.sparkSession, counted)
    return np.sort(found.to_numpy().astype(np.uint64))


def reach(like: Similarity, xn, xr, yn, yr):
    """Whether two sets that first meet at places xr and yr of their orders can still share enough."""
    import numpy as np

    return np.minimum(xn - xr, yn - yr) >= like.overlap(xn, yn)


def reach_sql(like: Similarity, xn: str, xr: str, yn: str, yr: str) -> str:
    return f"least({xn} - {xr}, {yn} - {yr}) * {like.num + like.den} >= {like.num} * ({xn} + {yn})"


def near_by_sketch(like: Similarity, xn: str, yn: str, other: str) -> str:
    """Whether folded sketches, f0... here and those of the other side, allow that two sets of these sizes share enough."""
    apart = " + ".join(f"bit_count(f{i} ^ {other}{i})" for i in range(FOLD))
    total, both = f"({xn} + {yn})", like.num + like.den
    return f"{apart} <= {total} - 2 * (({like.num} * {total} + {both - 1}) div {both})"


def verified(spark, docs: DataFrame, classes: DataFrame, pairs: DataFrame, like: Similarity, words: int) -> DataFrame:
    """The pairs of nodes (a, b) that are links."""
    def possible(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("xs", "ys"))
            apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            n = batch.column("xn").to_numpy() + batch.column("yn").to_numpy()
            yield batch.filter(pa.array(apart <= n - 2 * like.overlap(0, n))).select(["a", "b", "x", "y"])

    pairs = written(pairs, "pairs")
    nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
    known = picked(classes, "node", nodes)
    x = known.selectExpr("node as a", "rep as x", "n as xn", "sketch as xs")
    y = known.selectExpr("node as b", "rep as y", "n as yn", "sketch as ys")
    schema = "a long, b long, x struct<doc: long, tag: string>, y struct<doc: long, tag: string>"
    left = written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "xn", "yn", "xs", "ys").mapInArrow(possible, schema), "possible")
    asked = left.select("x.doc", "x.tag").union(left.select("y.doc", "y.tag")).distinct()
    # Rows with a wanted hash first, which takes no shuffle while those are few; of these, the wanted ones.
    hashes = written(asked.select(F.xxhash64("doc", "tag").alias("hash")).distinct(), "wanted")
    near = picked(docs.withColumn("hash", F.xxhash64("doc", "tag")), "hash", hashes)
    texts = written(near.select("doc", "tag", "text").join(asked, ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"]), "texts")
    free_shuffles(spark)
    # The query of a pair is its smaller node, whose text goes before those of its partners, in groups of ``SPOKES``.
    many = written(left.groupBy("a", "x").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("hands")), "queries")
    theirs = left.join(many.select("a", "hands"), "a").join(texts.select(F.struct("doc", "tag").alias("y"), "text"), "y").select(
        "a", F.pmod(F.xxhash64("b"), "hands").cast("int").alias("hand"), "b", "text")
    own = many.join(texts.select(F.struct("doc", "tag").alias("x"), "text"), "x").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("hands") - 1)).alias("hand"), F.lit(None).cast("long").alias("b"), "text")
    dealt = own.union(theirs).repartition("a", "hand").sortWithinPartitions("a", "hand", F.col("b").asc_nulls_first())

    def count(batches):
        import pyarrow as pa

        place, query = None, []
        for whole in batches:
            for batch in slices(whole, SLICE):
                sets = shingle_sets(batch.column("text").to_pylist(), words)
                found, waiting, numbers = ([], []), [], []

                def settle():
                    needed = [like.overlap(len(query), len(o)) for o in waiting]
                    for i in divide_skip(query, waiting, needed):
                        found[0].append(place[0])
                        found[1].append(numbers[i])

                for a, hand, b, tokens in zip(*(batch.column(c).to_pylist() for c in ("a", "hand", "b")), sets):
                    if b is None:
                        settle()
                        place, query, waiting, numbers = (a, hand), tokens.tolist(), [], []
                    else:
                        waiting.append(tokens.tolist())
                        numbers.append(b)
                settle()
                if found[0]:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    done = written(dealt.mapInArrow(count, "a long, b long"), "links")
    drop(spark, pairs, nodes, hashes, left, texts, many)
    return done
