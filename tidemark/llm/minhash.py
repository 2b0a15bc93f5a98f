"""MinHash near-duplicate detection with min-max signatures.

Under each of H hash permutations both the least and the greatest value of a document's shingle set are kept, so H
evaluations give 2H signature values, each of which agrees between two sets with probability equal to their Jaccard
similarity. All of them are banded; documents that share a band are candidates; every link is confirmed on full sets.

Plan, for inputs of any size:

1. One scan makes each document's set digest, band keys and a one-bit sketch. Equal sets form a class, which gets a key of its
   own, in the order of the smallest ids, when the classes are written; from here on only classes take part, by their keys, so exact copies cost one partial
   aggregation and ids may repeat or be null.
2. Band rows meet in one aggregation by band that finds each bucket's hub (its smallest key) and one join back. No pairs
   within a bucket are made.
3. Only candidates' texts are read a second time to get their full sets, written to the shared folder.
4. Round 0 confirms each candidate against its smallest hub; round 1 against its other hubs, if they are not yet
   connected; round 2 checks members of one bucket that are still in different components, so no link between
   components goes unseen. After rounds 0 and 1 the close copies of a bucket are one component and emit nothing. What
   is left, mostly edited copies a little too far from the rest, is settled by rare items: similar sets share one in
   their prefixes, or none at all, and of n items of which r are rare they then share n - r at most. Those that could still be
   similar, made of items that many share, meet in finer bands of `FINE` values, which sets well below the threshold seldom share.
   Copies around one text still share many of those. So a member outside a band's largest component is held only against sets
   that can share enough with it: either those of its bands, or, if they are fewer, the owners of one of its least common items,
   since of two sets that are to share s of the c common items of one, the other owns one of any c - s + 1 of them.

A hub with very many partners is split: its pairs go to as many parts as their count asks for, and its set to each part once.

With 24 bands of 4 values a pair at similarity 0.85 is missed with probability 2e-8, at 0.8 with 3e-6; finer bands miss one at
the threshold with 1e-6. Sets hold 64-bit hashes of shingles.

Defined cases: null or blank text has an empty set and is linked with nothing. Rows are judged one by one: rows that repeat an
id with other texts are linked by their texts, equal rows share a verdict. component_id is the smallest id that is reachable, null
if all reachable ids are null; a row is kept if it has that id (`keep_one` keeps exactly one row of a group). Columns
other than the id and the text are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bytes_of, constants, mix, per_slice, shingles, ship, slices, text_column, trim, words

#: Of an item: occurrences among the members of unsettled buckets up to which it is rare.
RARE = 16
#: Values of a finer band.
FINE = 12
#: Hubs that are split, at most; those with fewer partners than this share of all pairs are not.
SPLIT = 4096

_SIG = "id long, x long, n long, digest binary, bands array<long>, s0 long, s1 long"


def _values(u: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a sorted set under len(a) permutations."""
    low, high = np.full(len(a), 2**64 - 1, np.uint64), np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(u), 4096):
            y = u[None, at : at + 4096] * a[:, None]
            np.minimum(low, y.min(axis=1), out=low)
            np.maximum(high, y.max(axis=1), out=high)
        return mix(np.concatenate([low, high]))


def _bands(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of values; a band's values come from different permutations."""
    with np.errstate(over="ignore"):
        grid = values[: bands * rows].reshape(rows, bands)
        key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
        for r in range(rows):
            key = mix((key ^ grid[r]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r))
    return key.view(np.int64)


def _permutations(bands: int, rows: int) -> np.ndarray:
    """As many as give a value to each row of each band: two each."""
    return constants((bands * rows + 1) // 2, 23)


def _sketch(values: np.ndarray) -> np.ndarray:
    """One bit of up to 128 values; zeros behind."""
    bits = np.zeros(128, np.uint8)
    bits[: min(128, len(values))] = values[:128] & np.uint64(1)
    return np.packbits(bits).view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """docs(id, x, data) to one row of _SIG each."""
    a = _permutations(bands, rows)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_column(batch.column(2))
        h, at = words(data, offsets, lower=True)
        n, digest, keys, sketch = [], [], [], []
        for i in range(batch.num_rows):
            u = np.unique(shingles(h[at[i] : at[i + 1]], k))
            n.append(len(u))
            if len(u):
                digest.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                values = _values(u, a)
                keys.append(_bands(values, bands, rows))
                sketch.append(_sketch(values))
            else:
                digest.append(None)
                keys.append(np.zeros(0, np.int64))
                sketch.append(np.zeros(2, np.int64))
        sketch = np.array(sketch, np.int64).reshape(-1, 2)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists, pa.array(sketch[:, 0]), pa.array(sketch[:, 1])], ["id", "x", "n", "digest", "bands", "s0", "s1"])

    return per_slice(docs, "data", work, _SIG)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs(key, data) to (key, items): the sorted 64-bit shingle hashes as bytes. Of rows that follow each other with one key
    the first counts; after a sort by key that is one a task."""
    ship(docs.sparkSession)

    def run(batches):
        last = None
        for whole in batches:
            for batch in slices(whole, "data"):
                keys = batch.column(0).to_pylist()
                new = [key != before for key, before in zip(keys, [last, *keys])]
                last = keys[-1]
                batch = batch if all(new) else batch.filter(pa.array(new, pa.bool_()))
                if batch.num_rows:
                    data, offsets = text_column(batch.column(1))
                    h, at = words(data, offsets, lower=True)
                    items = [np.unique(shingles(h[at[i] : at[i + 1]], k)).tobytes() for i in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["key", "items"])
        trim()

    return docs.mapInArrow(run, "key long, items binary")


def fine_bands(sets: DataFrame, percent: int, rows: int = FINE) -> DataFrame:
    """sets(key, items) to (key, band): so many bands that two sets at the threshold share none with probability 1e-6."""
    bands = int(np.ceil(np.log(1e-6) / np.log1p(-((percent / 100) ** rows)))) if percent < 100 else 1
    a = _permutations(bands, rows)

    def run(batches):
        for batch in batches:
            for key, items in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = _bands(_values(np.frombuffer(items.as_buffer(), np.uint64), a), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, np.int64)), pa.array(found)], ["key", "band"])

    return sets.select("key", "items").mapInArrow(run, "key long, band long")


def _items(sets: DataFrame) -> DataFrame:
    """sets(key, items) to (key, item) with items cut to 32 bits: two that collide only look shared by more documents."""

    def run(batches):
        for batch in batches:
            data, offsets = text_column(batch.column(1))
            keys = batch.column(0).to_numpy()
            item = (np.frombuffer(data.tobytes(), np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for at in range(0, len(item), 1 << 17):
                part = item[at : at + (1 << 17)]
                owner = np.searchsorted(offsets // 8, np.arange(at, at + len(part)), "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array(part)], ["key", "item"])

    return sets.mapInArrow(run, "key long, item int")


def _split(pairs: DataFrame, split: int) -> tuple[DataFrame, DataFrame | None]:
    """pairs with a `part`, and (b, parts) of hubs `b` that have more than one: those with more than a `split`-th of all pairs and
    4096 at least, so `split` rows at most."""
    most = max(4096, pairs.count() // split)
    hot = pairs.groupBy("b").agg(F.count("*").alias("c")).filter(F.col("c") > most).collect()
    if not hot:
        return pairs.withColumn("part", F.lit(0)), None
    parts = pairs.sparkSession.createDataFrame([(r["b"], -(-r["c"] // most)) for r in hot], "b long, parts int")
    return pairs.join(F.broadcast(parts), "b", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts"), parts


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, split: int = SPLIT) -> DataFrame:
    """pairs(a, b, u, v) whose full sets have 100 * intersection >= percent * union; returns (u, v)."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * common >= percent * (len(both) - common)
            if keep.any():
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    pairs, parts = _split(pairs, split)
    x, y = sets.select(F.col("key").alias("a"), F.col("items").alias("x")), sets.select(F.col("key").alias("b"), F.col("items").alias("y"))
    if parts is None:
        y = y.withColumn("part", F.lit(0))
    else:
        y = y.join(F.broadcast(parts), "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return pairs.hint("merge").join(x, "a").hint("merge").join(y, ["b", "part"]).select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label): for every node of edges(u, v) the smallest id in its component.

    Minimum labels go along edges and through pointers until nothing changes; each step is two joins and one partial
    aggregation, written to the shared folder.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = scratch.put(both, f"{name}-edges")
    labels = scratch.put(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("changed")), f"{name}-0")
    step = 0
    while True:
        step += 1
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = labels.select("id", "label").join(up, "label", "left").select("id", "label", F.least("label", "up").alias("to"))
        near = both.join(labels.select(F.col("id").alias("v"), F.col("label").alias("l")), "v").groupBy(F.col("u").alias("id")).agg(F.min("l").alias("l"))
        after = jumped.join(near, "id", "left").select("id", F.least("to", "l").alias("to"), "label")
        labels = scratch.put(after.select("id", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("changed")), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        if not labels.filter("changed").take(1):
            scratch.drop(f"{name}-edges")
            return labels.select("id", "label")


def _fallback(members: DataFrame, own: DataFrame, rare: DataFrame, items: DataFrame, sets: DataFrame, close, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b, u, v) of members that can be similar though they share no rare item.

    They share a finer band instead. In a band the members of all components but its largest look for partners, each by the cheaper of
    two ways: through its bands, or through the common items that it must share one of.
    """
    reach = lambda c, n, other: 100 * c >= percent * (n + other - c)  # noqa: E731  sets of n and other items that share c at most
    common = members.join(own, "key", "left").withColumn("c", F.col("n") - F.coalesce(F.col("r"), F.lit(0))).filter(100 * F.col("c") >= percent * F.col("n")).drop("r")
    common = scratch.put(common, "common")
    bands = scratch.put(fine_bands(sets.join(common.select("key"), "key", "left_semi"), percent).distinct(), "fine-bands")
    met = bands.join(common, "key")
    counts = met.groupBy("band", "label").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    main = counts.groupBy("band").agg(F.max(F.struct("m", "label")).alias("main"), F.count("*").alias("labels"), F.sum("m").alias("size"), F.min("least").alias("least"))
    main = main.filter("labels > 1").select("band", F.col("main.label").alias("main"), "size", "least")
    met = scratch.put(met.join(main, "band").filter(reach(F.col("c"), F.col("n"), F.col("least"))), "met")
    off = met.filter("label <> main")
    most = F.least("x.c", "y.c")
    fits = close & reach(most, F.col("x.n"), F.col("y.n"))

    # A seeker's common items, those of fewest owners first: if the first one that it shares stands at a place, it shares `rest` at
    # most, which is enough for partners of `low` to `high` items.
    seekers = scratch.put(off.groupBy("key", "n", "s0", "s1", "label", "c").agg(F.sum("size").alias("cost"), F.min("least").alias("least")), "seekers")
    held = scratch.put(items.join(common, "key"), "held")
    owners = scratch.put(held.groupBy("item", F.col("n").alias("size")).agg(F.count("*").alias("m")), "owners")
    scarce = rare.join(seekers.select("key"), "key", "left_semi").select("key", "item")
    listed = held.select("key", "item").join(seekers, "key").join(scarce, ["key", "item"], "left_anti").join(owners.groupBy("item").agg(F.sum("m").alias("owned")), "item")
    listed = listed.withColumn("rest", F.col("c") - F.row_number().over(Window.partitionBy("key").orderBy("owned", "item")) + 1)
    listed = listed.withColumn("low", F.greatest("least", F.ceil(F.col("n") * percent / 100))).filter(reach(F.col("rest"), F.col("n"), F.col("low")))
    listed = scratch.put(listed.withColumn("high", F.floor(F.col("rest") * (100 + percent) / percent) - F.col("n")).drop("least"), "listed")
    lengths = F.sum(F.least("owned", F.col("high") - F.col("low") + 1))
    brief = listed.groupBy("key").agg(lengths.alias("spots"), F.first("cost").alias("cost")).select("key", (F.col("spots") < F.col("cost")).alias("brief"))
    spots = listed.join(brief.filter("brief").select("key"), "key", "left_semi").join(owners, "item").filter("size between low and high")
    spots = scratch.put(spots.select("key", "n", "s0", "s1", "label", "c", "cost", "item", "size", "m"), "spots")
    dear = spots.groupBy("key").agg(F.sum("m").alias("m"), F.first("cost").alias("cost")).filter("m >= cost").select("key")
    through = scratch.put(brief.filter("not brief").select("key").union(dear), "through-bands")

    by_band = off.join(through, "key", "left_semi").alias("x").join(met.alias("y"), (F.col("x.band") == F.col("y.band")) & fits)
    at = (F.col("x.item") == F.col("y.item")) & (F.col("x.size") == F.col("y.n"))
    by_item = spots.join(through, "key", "left_anti").alias("x").join(held.alias("y"), at & fits)
    return by_band.select(*_pair()).union(by_item.select(*_pair())).distinct()


def judged(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, x (a hash of the text), n (set size), label (the group, null without words), component (its smallest id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash", docs)
    docs = _keyed(docs, id_col, text_col)
    sig = scratch.put(signatures(docs, k, bands, rows), "signatures")

    first = sig.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x", "n", "bands", "s0", "s1")).alias("r"))
    order = ("none", "id", "digest")  # keys in the order of ids: a hub is then the oldest of its bucket, which its copies are most like
    first = first.select("digest", "r.*").repartitionByRange(*order).sortWithinPartitions(*order)
    reps = scratch.put(first.select(F.monotonically_increasing_id().alias("key"), "*"), "representatives")  # keys hold once written
    band_rows = reps.select("key", F.explode("bands").alias("band"))
    buckets = band_rows.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter("hub < last").select("band", "hub")
    hits = scratch.put(band_rows.join(buckets, "band").select("band", "key", "hub"), "buckets")
    nodes = scratch.put(reps.join(hits.select("key").distinct(), "key", "left_semi").select("key", "id", "x", "n", "s0", "s1"), "nodes")
    same = F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.x") == F.col("r.x"))
    sets = scratch.put(full_sets(docs.alias("d").join(nodes.select("key", "id", "x").hint("merge").alias("r"), same).select("r.key", "d.data"), k), "sets")

    state, latest = nodes.select("key", "n", "s0", "s1", F.col("key").alias("label")), "nodes"

    def advance(pairs: DataFrame, name: str) -> None:
        nonlocal state, latest
        pairs = scratch.put(pairs.select("a", "b", "u", "v"), f"pairs-{name}")
        if pairs.take(1):
            links = scratch.put(_confirm(pairs, sets, percent), f"links-{name}")
            if links.take(1):
                merged = components(links, scratch, f"components-{name}").select(F.col("id").alias("label"), F.col("label").alias("to"))
                state = scratch.put(state.join(merged, "label", "left").select("key", "n", "s0", "s1", F.coalesce("to", "label").alias("label")), f"state-{name}")
                latest = f"state-{name}"

    advance(hits.filter("key <> hub").groupBy("key").agg(F.min("hub").alias("b")).select(F.col("key").alias("a"), "b", F.col("key").alias("u"), F.col("b").alias("v")), "0")

    # a pair at the threshold agrees in (1 + J) / 2 of the sketch's bits; six standard deviations below are let through
    j, bits = (1 + percent / 100) / 2, min(128, bands * rows)
    differ = bits - int(bits * j - 6 * (bits * j * (1 - j)) ** 0.5)
    close = (
        (F.col("x.label") != F.col("y.label"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0"))) + F.bit_count(F.col("x.s1").bitwiseXOR(F.col("y.s1"))) <= differ)
    )
    ends = (F.col("x.key").alias("a"), F.col("y.key").alias("b"), F.col("x.label").alias("u"), F.col("y.label").alias("v"))

    links = hits.filter("key <> hub").select("key", "hub").distinct().alias("h")
    advance(links.join(state.alias("x"), F.col("h.key") == F.col("x.key")).join(state.alias("y"), F.col("h.hub") == F.col("y.key")).filter(close).select(*ends), "1")

    # Round 2. Items of the members of unsettled buckets, rarest first, are in one order. Two sets that are similar enough
    # share an item within their prefixes of n - ceil(percent * n) + 1 items. If that is a rare one, a join on rare items finds them;
    # else they share no rare item at all, which bounds what they share.
    members = scratch.put(hits.select("band", "key").join(state, "key"), "members")
    unsettled = members.groupBy("band").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("band")
    crowd = scratch.put(members.join(unsettled, "band", "left_semi").select("key", "n", "s0", "s1", "label").distinct(), "unsettled")
    if crowd.take(1):
        items = scratch.put(_items(sets.join(crowd.select("key"), "key", "left_semi")), "items")
        rare = items.groupBy("item").agg(F.count("*").alias("c")).filter(F.col("c") <= RARE)
        rare = scratch.put(items.join(rare, "item").select("key", "item", "c"), "rare")
        own = rare.groupBy("key").agg(F.count("*").alias("r"))
        place = F.rank().over(Window.partitionBy("key").orderBy("c", "item"))
        length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
        prefix = rare.withColumn("place", place).join(crowd, "key").filter((F.col("place") <= length) & (F.col("c") > 1))
        prefix = scratch.put(prefix.select("key", "item", "n", "s0", "s1", "label"), "prefixes")
        sharing = prefix.alias("x").join(prefix.alias("y"), (F.col("x.item") == F.col("y.item")) & (F.col("x.key") < F.col("y.key")) & close).select(*_pair())
        advance(sharing.union(_fallback(crowd, own, rare, items, sets, close, percent, scratch)).distinct(), "2")

    scratch.keep("signatures", "representatives", latest)
    found = reps.select("key", "digest", "none", "id").join(state.select("key", "label"), "key")
    least = found.groupBy("label").agg(F.min(F.struct("none", "id")).alias("least"))
    named = found.join(least, "label").select("key", "label", F.col("least.id").alias("component"))
    classes = reps.select("key", "digest", "id").join(named, "key", "left")
    classes = classes.select("digest", F.coalesce("label", "key").alias("label"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
    out = sig.select("id", "x", "n", "digest").join(classes, "digest", "left")
    return out.select("id", "x", "n", "label", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def _pair() -> tuple:
    """The ends of x and y in one order: a < b by key, u < v by label."""
    return F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"), F.least("x.label", "y.label").alias("u"), F.greatest("x.label", "y.label").alias("v")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    data = bytes_of(F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(data).alias("x"), data.alias("data"), *more)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles; component_id is
    the smallest id reachable over links. Options are those of `judged`.
    """
    kept = F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull())
    return judged(docs, **options).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one of each group of near duplicates, with all their columns.

    The one of smallest id stays (null ids last; of several texts with that id, the one of smallest hash). Of rows that repeat both id
    and text any one stays. Documents without words are in no group and all stay. Options are those of `judged`.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    scratch = Scratch(docs.sparkSession, "keep-one", docs)
    rows = scratch.put(judged(docs, **options).filter("label is not null").select("id", "x", "label"), "judged")
    groups = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "x")).alias("w"), F.count("*").alias("c")).filter("c > 1")
    met = rows.join(groups, "label").withColumn("won", F.col("id").eqNullSafe(F.col("w.id")) & (F.col("x") == F.col("w.x")))
    marks = met.groupBy("id", "x").agg(F.max("won").alias("won"), F.count("*").alias("c"))  # rows of one id and text are in one group
    marks = scratch.put(marks.filter("not won or c > 1").select("id", "x", "won"), "marks")
    row = _keyed(docs, id_col, text_col, F.struct(*docs.columns).alias("row")).drop("data").alias("d")

    def meets(m: DataFrame, how: str) -> DataFrame:
        return row.join(m.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.x") == F.col("m.x")), how)

    out = meets(marks, "left_anti").select("row")
    if marks.filter("won").take(1):
        out = out.union(meets(marks.filter("won"), "left_semi").dropDuplicates(["id", "x"]).select("row"))
    return out.select("row.*")
