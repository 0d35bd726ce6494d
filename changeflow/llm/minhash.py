"""Near-duplicates by MinHash: banding, verification, connected components.

A document's set is its distinct shingles of five words. Documents with equal sets are one class, a node
of the graph with a number of its own, so copies cost nothing further. Each set has 125 minima of universal
hashes; 25 bands of five of them put classes into buckets. Two sets of 85 % overlap miss each other
in all bands in four of ten million cases.

Links are looked for without making all pairs of a bucket. In a few turns every bucket names a leader,
the member with most links so far, and compares it with the members of other components; hubs of a group of
near copies come to lead, and most groups are joined by their links to them. Only what is still apart then
is compared with all members of its buckets, in blocks inside the tasks, of which only links come out. So at
the end any two documents of one bucket are in one component or have been compared. A pair is compared by size, then by its minima
(beyond seven deviations under the threshold it is dropped), then by full sets.

Stages are written to the shared folder; no list of documents, links or components reaches the driver.

Defined results: null and empty texts, and those of white space, have an empty set and are linked with
nothing. With fewer than five words the whole sequence is the one shingle. Rows that repeat an id are one
node of ``near_duplicates``: it joins the components of all their texts, and each row is returned with the
component of the node. A row with a null id belongs to the component of its text; if no row there has an id,
its component is null and it counts as kept. Very long texts are shingled whole. Only the id and the text
are read.

``keep_one_of_each`` looks at texts alone, so that an id that stands for different texts loses none of them:
of every group of linked texts one row stays, that of the smallest id (rows with an id before those without),
then of the smallest fingerprint, then of the smallest text and row. Rows with an empty set all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm import textbytes as tb
from changeflow.llm.components import components, gathered, stored
from changeflow.session import work_dir

SHINGLE = 5
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Overlap in hundredths from which two documents are linked.
SIMILAR = 85
#: Equal minima below which a pair is not compared further: 85 % less seven standard deviations.
LEAST_EQUAL = 78
TURNS = 3
#: Common shingles that collisions of 32-bit hashes could feign; one is rare, and more are rarer still.
COLLISIONS = 4
#: Bytes of sets on one side of a task.
VERIFY_BYTES = 8_000_000
#: Ids that are sent to all executors rather than shuffling texts to them: 8 MB. They are counted before.
BROADCAST_IDS = 1_000_000
#: Shingles hashed together, so that they stay in a core's cache.
CHUNK = 32_768

_RNG = np.random.default_rng(41)
_FACTOR = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**64, HASHES, dtype=np.uint64)


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, sorted within each, and how many each text has."""
    b = tb.Batch(texts)
    data = tb.LOWER[b.data]
    begin, end = b.runs(~tb.SPACE[data])
    text = b.text_of(begin)
    words = np.bincount(text, minlength=len(b))
    first = np.cumsum(words) - words
    window, keys, owners = b.hashes(data, begin, end), [], []
    h = window
    for n in range(1, SHINGLE + 1):
        if n > 1:
            window = window[:-1] * tb.WINDOW + h[n - 1 :] if len(h) >= n else h[:0]
        if n < SHINGLE:
            own = np.flatnonzero(words == n)
            at = first[own]
        else:
            at = np.flatnonzero(text[: len(window)] == text[n - 1 :]) if len(window) else np.empty(0, np.int64)
            own = text[at]
        keys.append(tb.mix(window[at] + np.uint64(n)))
        owners.append(own)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key)
    order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], np.bincount(owner[new], minlength=len(b))


def signatures(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The minima of each set, a row each; sets of no element get zeros."""
    out = np.zeros((len(size), HASHES), np.uint32)
    full = np.flatnonzero(size)
    ends = np.cumsum(size[full])
    k = 0
    while k < len(full):
        # Sets that fit a chunk together; a larger one alone, in parts.
        begin = ends[k] - size[full[k]]
        stop = max(k + 1, int(np.searchsorted(ends, begin + CHUNK, side="right")))
        part = keys[begin : ends[stop - 1]]
        starts = (ends[k:stop] - size[full[k:stop]] - begin).astype(np.int64)
        if stop == k + 1 and len(part) > CHUNK:
            pieces = [_minima(part[a : a + CHUNK], np.zeros(1, np.int64)) for a in range(0, len(part), CHUNK)]
            out[full[k]] = np.min(pieces, axis=0)[0]
        else:
            out[full[k:stop]] = _minima(part, starts)
        k = stop
    return out


def _minima(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), HASHES), np.uint32)
    values = np.empty_like(keys)
    for i in range(HASHES):
        np.multiply(keys, _FACTOR[i], out=values)
        np.add(values, _ADD[i], out=values)
        out[:, i] = np.minimum.reduceat(values, starts) >> np.uint64(32)
    return out


def _fingerprints(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128 bits of each set, in two columns."""
    out = np.zeros((len(size), 2), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        starts = np.cumsum(size[full]) - size[full]
        for c, salt in enumerate((np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179))):
            out[full, c] = np.add.reduceat(tb.mix(keys ^ salt), starts)
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, the set's fingerprint ``f1, f2`` and its minima ``sig``; null for empty sets."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for whole in batches for part in tb.frames(whole)):
            keys, size = shingle_sets(b.text)
            sig, print_ = signatures(keys, size), _fingerprints(keys, size)
            some = size > 0
            out = pd.DataFrame({"doc_id": b.doc_id, "n_shingles": size})
            out["f1"] = pd.Series(print_[:, 0], index=b.index, dtype="Int64").where(some)
            out["f2"] = pd.Series(print_[:, 1], index=b.index, dtype="Int64").where(some)
            out["sig"] = pd.Series([r.tobytes() if s else None for r, s in zip(sig, some, strict=True)], index=b.index, dtype=object)
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        sketch, "doc_id long, n_shingles long, f1 long, f2 long, sig binary"
    )


def _light(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, at most ``n``, to be broadcast if that is few; else Spark shuffles both sides."""
    return F.broadcast(rows) if n <= BROADCAST_IDS else rows


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, to be broadcast if a count shows that they are few."""
    return _light(ids, ids.count())


def _blank(text: Column) -> Column:
    """Whether a text has no word."""
    return ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep`` and its ``set`` (sorted hashes) for the classes in ``wanted`` (``rep``, ``doc_id``, ``f1``, ``f2``)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for whole in batches for part in tb.frames(whole)):
            keys, size = shingle_sets(b.text)
            ends, print_ = np.cumsum(size), _fingerprints(keys, size)
            sets = [keys[e - s : e].tobytes() for e, s in zip(ends, size, strict=True)]
            yield pd.DataFrame({"f1": print_[:, 0], "f2": print_[:, 1], "set": sets})

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    ids = wanted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    some = texts.join(_few(ids), "doc_id", "left_semi")
    if not wanted.where(F.col("doc_id").isNull()).isEmpty():
        some = some.unionByName(texts.where(F.col("doc_id").isNull()))
    made = some.mapInPandas(make, "f1 long, f2 long, set binary")
    return made.join(wanted.select("rep", "f1", "f2"), ["f1", "f2"]).select("rep", "set").dropDuplicates(["rep"])


def _equal_minima(a: Column, b: Column) -> Column:
    """How many minima two sets share."""

    @F.pandas_udf("int")
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), np.uint32).reshape(-1, HASHES)
        y = np.frombuffer(b"".join(b), np.uint32).reshape(-1, HASHES)
        return pd.Series((x == y).sum(axis=1))

    return equal(a, b)


def _alike_size(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


def _likely(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Those ``a, b`` whose sizes and minima allow a link, with the size of ``a``."""
    m = members.select("rep", "n_shingles", "sig")
    left = m.toDF("a", "n_a", "sig_a")
    right = m.toDF("b", "n_b", "sig_b")
    met = pairs.join(left, "a").join(right, "b").where(_alike_size(F.col("n_a"), F.col("n_b")))
    return met.where(_equal_minima(F.col("sig_a"), F.col("sig_b")) >= LEAST_EQUAL).select("a", "b", "n_a")


def _overlap(x: np.ndarray, y: np.ndarray, less: int = 0) -> bool:
    """Whether two sorted sets are linked, also if ``less`` fewer were common."""
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) - less
    return 100 * common >= SIMILAR * (len(x) + len(y) - common)


def _shortened(sets: DataFrame) -> DataFrame:
    """Sets of the upper halves of the hashes, still sorted. They overlap as much or a little more."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(set=[(np.frombuffer(s, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for s in b.set])

    return sets.mapInPandas(cut, "rep long, set binary")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b`` of the pairs, which are distinct, that overlap enough, by full sets. Many partners of one ``a`` are split."""
    n = pairs.count()
    load = gathered(pairs, n).groupBy("a").agg((F.count("*") * F.max("n_a") * 8).alias("bytes"))
    chunks = _light(load.select("a", F.ceil(F.col("bytes") / VERIFY_BYTES).cast("int").alias("chunks")), n)
    right = (
        pairs.select("a", "b")
        .join(chunks, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
        .join(sets.toDF("b", "set_b"), "b")
    )
    left = sets.toDF("a", "set_a").join(chunks, "a")
    left = left.select("a", "set_a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def compare(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a, raw in zip(own.a, own.set_a, strict=True):
            x = np.frombuffer(raw, np.uint64)
            for b, other in zip(others.b, others.set_b, strict=True):
                if _overlap(x, np.frombuffer(other, np.uint64)):
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.groupBy("a", "chunk").cogroup(right.groupBy("a", "chunk")).applyInPandas(compare, "a long, b long")


def _leaders(state: DataFrame, turn: int) -> DataFrame:
    """For each bucket of several components: its leader, the leader's component, its members."""
    best = F.max(F.struct("degree", F.xxhash64(F.lit(turn), "rep").alias("h"), "rep", "component")).alias("best")
    named = state.groupBy("key").agg(best, F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n"))
    mixed = named.where(F.col("c") < F.col("d"))
    return mixed.select("key", F.col("best.rep").alias("leader"), F.col("best.component").alias("lead"), "n")


def _rest_pairs(state: DataFrame, members: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Pairs of all documents outside their bucket's leading component with its other components.

    Both sides come in blocks of bounded bytes, with sets of half the size. A pair is compared in the first
    band that it shares, inside the task, and no further once the document is linked with that component
    beyond doubt. Only pairs come out that are links but for collisions of short hashes.
    """
    mixed = state.join(_leaders(state, TURNS).drop("n"), "key").join(members.select("rep", "n_shingles"), "rep")
    mixed = stored(mixed, f"{folder}/mixed")  # without sets: what the buckets weigh is asked before they are joined
    load = stored(mixed.groupBy("key").agg(F.sum(F.col("n_shingles") * 4 + 4 * HASHES).alias("bytes")), f"{folder}/load")
    total, n = load.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    mixed = mixed.join(_light(load, n), "key").withColumn("blocks", F.ceil(F.col("bytes") / VERIFY_BYTES).cast("int"))
    mixed = mixed.join(members.select("rep", "sig").join(_shortened(sets), "rep"), "rep")
    # Small buckets share a task, large ones have several of their own.
    together = F.pmod(F.xxhash64("key"), F.lit(-(-total // VERIFY_BYTES) or 1))
    mixed = mixed.withColumn("task", F.when(F.col("blocks") == 1, together).otherwise(F.col("key")))
    part = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["task", "block", "turn", "key", "band", "rep", "component", "n_shingles", "sig", "set"]
    every = mixed.withColumn("block", part).withColumn("turn", others).select(*columns)
    rest = mixed.where(F.col("component") != F.col("lead")).withColumn("turn", part).withColumn("block", others)
    rest = rest.select(*columns).toDF(*(f"q_{c}" for c in columns))  # both sides come from one table

    def compare(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(block):
            block = block.sort_values("key")
            sig = np.frombuffer(b"".join(block.sig), np.uint32).reshape(-1, HASHES)
            keys, rep, group, n = (block[c].to_numpy() for c in ("key", "rep", "component", "n_shingles"))
            sets = [np.frombuffer(x, np.uint32) for x in block.set]
            for r in some.itertuples():
                bucket = slice(np.searchsorted(keys, r.q_key), np.searchsorted(keys, r.q_key, side="right"))
                equal = sig[bucket] == np.frombuffer(r.q_sig, np.uint32)
                first = equal.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
                number, size = equal.sum(axis=1), n[bucket]
                at = np.flatnonzero(
                    (group[bucket] != r.q_component)
                    & (100 * np.minimum(size, r.q_n_shingles) >= SIMILAR * np.maximum(size, r.q_n_shingles))
                    & (number >= LEAST_EQUAL)
                    & (first == r.q_band)
                )
                own, joined = np.frombuffer(r.q_set, np.uint32), set()
                for i in (bucket.start + at[np.argsort(-number[at], kind="stable")]).tolist():
                    if group[i] not in joined and _overlap(own, sets[i]):
                        if _overlap(own, sets[i], COLLISIONS):
                            joined.add(group[i])
                        out.append((r.q_rep, rep[i], r.q_n_shingles))
        return pd.DataFrame(out, columns=["a", "b", "n_a"]).astype("int64")

    by = ("task", "block", "turn")
    both = rest.groupBy(*(f"q_{c}" for c in by)).cogroup(every.groupBy(*by))
    return both.applyInPandas(compare, "a long, b long, n_a long").distinct()


def _band_keys(sig: Column) -> Column:
    width = 4 * ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring(sig, 1 + i * width, width)) for i in range(BANDS)])


def linked(docs: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """``rep`` and ``component``: the classes linked with one of a smaller number, and the smallest number."""
    spark = docs.sparkSession
    banded = classes.select("rep", F.posexplode(_band_keys(F.col("sig"))).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    buckets = stored(banded.join(shared, "key", "left_semi").distinct(), f"{folder}/buckets")
    members = stored(classes.join(buckets.select("rep").distinct(), "rep", "left_semi"), f"{folder}/members")
    sets = stored(_sets(docs, members.select("rep", "doc_id", "f1", "f2")), f"{folder}/sets")
    found = spark.createDataFrame([], "rep long, component long")
    degree = spark.createDataFrame([], "rep long, degree long")
    compared = spark.createDataFrame([], "a long, b long")
    links, n_compared, n_links = compared, 0, 0
    for turn in range(TURNS + 1):
        # Every link adds one row to ``found`` and two to ``degree`` at most.
        state = (
            buckets.join(_light(found, n_links), "rep", "left")
            .join(_light(degree, 2 * n_links), "rep", "left")
            .withColumn("component", F.coalesce("component", "rep"))
            .withColumn("degree", F.coalesce("degree", F.lit(0)))
        )
        if turn < TURNS:
            led = state.join(_leaders(state, turn), "key").where(F.col("component") != F.col("lead"))
            led = led.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct()
            pairs = stored(led.join(_light(compared, n_compared), ["a", "b"], "left_anti"), f"{folder}/pairs-{turn}")
            n_pairs = pairs.count()
            if not n_pairs:
                if _leaders(state, turn).isEmpty():
                    break
                continue  # stable leaders have seen all they can, but the other members not each other
            compared, n_compared = compared.unionByName(pairs), n_compared + n_pairs
            likely = stored(_likely(pairs, members), f"{folder}/likely-{turn}")
        else:
            likely = stored(_rest_pairs(state, members, sets, folder), f"{folder}/likely-{turn}")
        new = stored(_verify(likely, sets), f"{folder}/links-{turn}")
        n_new = new.count()
        if not n_new:
            continue
        links, n_links = links.unionByName(new), n_links + n_new
        if turn < TURNS:
            ends = gathered(links, n_links).select(F.explode(F.array("a", "b")).alias("rep"))
            degree = stored(ends.groupBy("rep").agg(F.count("*").alias("degree")), f"{folder}/degree-{turn}")
        edges = found.toDF("u", "v").unionByName(new.toDF("u", "v"))
        found = components(edges, f"{folder}/components-{turn}", n_links + n_new).toDF("rep", "component")
    return found


def _placed(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and every class (``f1``, ``f2``, its smallest id ``least``) with its ``group`` of linked texts."""
    drawn = stored(sketches(docs), f"{folder}/sketches")
    classes = drawn.where(F.col("f1").isNotNull()).groupBy("f1", "f2")
    classes = classes.agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # Numbered as they are stored, so that a repeated task doesn't number them anew.
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), f"{folder}/classes")
    found = linked(docs, classes, folder)
    placed = classes.select("f1", "f2", F.col("doc_id").alias("least"), "rep").join(found, "rep", "left")
    return drawn, placed.select("f1", "f2", "least", F.coalesce("component", "rep").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row."""
    folder = work_dir(docs.sparkSession, "minhash")
    drawn, placed = _placed(docs, folder)
    rows = drawn.select("doc_id", "n_shingles", "f1", "f2").where(F.col("f1").isNotNull()).join(placed, ["f1", "f2"])
    rows = stored(rows.select("doc_id", "n_shingles", "group", "least"), f"{folder}/rows")
    # Groups that one id joins; usually there are none.
    several = rows.groupBy("doc_id").agg(F.min("group").alias("u"), F.max("group").alias("v")).where("doc_id IS NOT NULL AND u < v")
    several = stored(several, f"{folder}/several")
    if not several.isEmpty():
        joined = rows.join(several, "doc_id").select(F.col("u"), F.col("group").alias("v")).distinct()
        joined = components(joined, f"{folder}/joined").toDF("group", "onto")
        rows = rows.join(joined, "group", "left").withColumn("group", F.coalesce("onto", "group")).drop("onto")
    least = rows.groupBy("group").agg(F.min("least").alias("component_id"))
    rows = rows.join(least, "group").select("doc_id", "n_shingles", "component_id")
    empty = drawn.where(F.col("f1").isNull()).select("doc_id", "n_shingles")
    # An empty text under an id that has other texts too belongs to their node.
    ids = empty.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    same = rows.join(_few(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = empty.join(same, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = rows.unionByName(empty)
    stays = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.withColumn("kept", stays)


def _chosen_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``doc_id`` (or null), ``f1``, ``f2`` in ``chosen``."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, size = shingle_sets(batch.column("text").to_pylist())
            f1, f2 = (pa.array(c, pa.int64()) for c in _fingerprints(keys, size).T)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), f1, f2], ["row", "doc_id", "f1", "f2"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("doc_id", "f1", "f2"))])
    marked = rows.mapInArrow(mark, schema).alias("d").join(chosen.alias("c"), ["f1", "f2"])
    marked = marked.where(F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))).select("row", "c.doc_id", "f1", "f2")
    order = F.struct(F.col("row.text"), F.to_json("row"))
    return marked.groupBy("doc_id", "f1", "f2").agg(F.min_by("row", order).alias("row")).select("row.*")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of linked texts, and those without words."""
    folder = work_dir(docs.sparkSession, "kept")
    drawn, placed = _placed(docs, folder)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "f1", "f2")).alias("c")
    chosen = placed.groupBy("group").agg(first).select("c.doc_id", "c.f1", "c.f2")
    rows = drawn.where(F.col("f1").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"))
    chosen = stored(chosen.join(rows, "doc_id", "left"), f"{folder}/chosen")
    blank = _blank(F.col("text"))
    single = chosen.where(F.col("n") == 1).select("doc_id")
    out = docs.where(blank).unionByName(docs.where(~blank).join(_few(single), "doc_id", "left_semi").select(*docs.columns))
    # Ids that repeat, or are null, don't tell rows apart: those rows are told apart by their sets.
    rest = chosen.where(F.coalesce(F.col("n"), F.lit(0)) != 1).drop("n")
    if not rest.isEmpty():
        ids = rest.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
        texts = docs.where(~blank)
        some = texts.join(_few(ids), "doc_id", "left_semi").select(*docs.columns)
        out = out.unionByName(_chosen_rows(some.unionByName(texts.where(F.col("doc_id").isNull())), rest))
    return out
