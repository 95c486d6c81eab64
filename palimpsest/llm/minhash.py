"""MinHash near-duplicates: universal hash minima, banding, signature and exact verification, components.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit fingerprint
   of the shingle set, ``BANDS * ROWS`` universal hash minima (a byte of each is kept as signature)
   and a key for each band of ``ROWS``.
2. Documents with equal sets form a class; only its smallest id goes on.
3. Within each bucket of a band every member is compared with one pivot, the smallest id.  The
   minimum is combined before the shuffle, and no bucket is ever listed as all its pairs.
4. A pair goes on if the signatures agree often enough, and becomes a link if its full sets do.
5. Links join classes by large-star and small-star.  A member of a bucket that is not in its pivot's
   component is compared with two further members, another in each bucket.
6. Those still outside are compared with all members of other components in their buckets, in blocks
   of ``BLOCK`` documents that hold signatures and sets: each pair in the first band that it shares,
   by its signatures and then by its sets.  Only links leave a block, and none between two
   components of a bucket is lost.

A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**6)**42, over 0.999997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import connected_components
from palimpsest.llm.scratch import cut, map_arrow, release
from palimpsest.llm.textkernel import chunks, mix, shingle_hashes, words_of

BANDS, ROWS = 42, 6
#: Default shingle length in words, and similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Pairs whose estimated similarity is lower than asked by more than this are no candidates: over four
#: standard deviations of the estimate by 252 minima.
SLACK = 0.11
#: Signatures of either side that are compared at once.
BLOCK = 256

_rng = np.random.default_rng(7919)
_A = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
_EMPTY = np.zeros(0, np.uint64)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z count as a-z.

    A text of fewer than k words has one shingle, the whole sequence; one without words has none.
    """
    for c in chunks(column):
        w = words_of(c, fold_case=True)
        whole = shingle_hashes(w.hashes, k)
        for i in range(c.n):
            a, b = w.bounds[i], w.bounds[i + 1]
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield shingle_hashes(w.hashes[a:b], int(b - a))[:1]
            else:
                yield _EMPTY


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash a * x + b over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        y = np.multiply.outer(_A, x[at : at + 4096])
        y += _B[:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def signature_of(least: np.ndarray) -> bytes:
    """A byte of each minimum; those of different minima agree once in 256."""
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def estimated(agreeing: np.ndarray) -> np.ndarray:
    """Similarity estimated from the share of agreeing bytes."""
    return (agreeing - 1 / 256) / (1 - 1 / 256)


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = _BAND.copy()
    for j in range(ROWS):
        key = mix(key ^ (rows[:, j] * np.uint64(0x9E3779B97F4A7C15)))
    return key.view(np.int64)


FEATURES = "doc_id long, n_shingles long, f1 long, f2 long, signature binary, bands array<long>"


def _feature_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            n, f1, f2, signatures, bands = [], [], [], [], []
            for s in shingle_sets(part.column(1), k):
                n.append(len(s))
                f1.append(mix(s).sum(dtype=np.uint64))
                f2.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if len(s):
                    signatures.append(signature_of(m := minima(s)))
                    bands.append(band_keys(m))
                else:
                    signatures.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)),
                    pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "f1", "f2", "signature", "bands"],
            )


def _source(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def features(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per document: set size, set fingerprint, minima and band keys."""
    return map_arrow(_source(docs, text), lambda it: _feature_batches(it, k), FEATURES)


def _agreeing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for x in ("sa", "sb"))
        keep = estimated((a == b).mean(axis=1)) >= percent / 100 - SLACK
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))


def _block_pairs(t: pa.Table, percent: int) -> pa.RecordBatch:
    """Links between components within runs of equal (key, bu, bv), one outsider and one member."""
    at = np.stack([t.column(x).to_numpy() for x in ("key", "bu", "bv")])
    cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
    doc, component, outsider, size = (t.column(x).to_numpy() for x in ("doc_id", "component", "outsider", "n_shingles"))
    marks = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    bands = pc.list_flatten(t.column("bands")).to_numpy().reshape(-1, BANDS)
    folded = [np.frombuffer(x, np.uint32) for x in t.column("folded").to_pylist()]
    us, vs = [], []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        x, y = lo + np.flatnonzero(outsider[lo:hi]), lo + np.flatnonzero(~outsider[lo:hi])
        band = int(np.argmax(bands[lo] == at[0, lo]))
        for i in x.tolist():
            z = y[component[y] != component[i]]
            z = z[100 * np.minimum(size[z], size[i]) >= percent * np.maximum(size[z], size[i])]
            z = z[~(bands[z, :band] == bands[i, :band]).any(axis=1)]
            z = z[estimated((marks[z] == marks[i]).mean(axis=1)) >= percent / 100 - SLACK]
            if not len(z):
                continue
            # folding never loses a common shingle, so no link is missed; the few more are confirmed later
            lens = np.array([len(folded[q]) for q in z])
            joined = np.concatenate([folded[q] for q in z])
            own = folded[i]
            hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
            common = np.add.reduceat(hit, np.cumsum(lens) - lens)
            z = z[100 * common >= percent * (size[z] + size[i] - common)]
            us.append(np.minimum(doc[i], doc[z]))
            vs.append(np.maximum(doc[i], doc[z]))
    both = [np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs)]
    return pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in both], ["u", "v"])


def _blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """``_block_pairs`` over sorted rows that may be cut anywhere into batches."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        last = [t.column(x)[-1].as_py() for x in ("key", "bu", "bv")] if t.num_rows else None
        if last is None:
            continue
        at = np.stack([t.column(x).to_numpy() for x in ("key", "bu", "bv")])
        whole = int(np.argmax((at == np.array(last)[:, None]).all(axis=0)))
        if whole:
            yield _block_pairs(t.slice(0, whole), percent)
        rest = t.slice(whole)
    if rest is not None:
        yield _block_pairs(rest, percent)


def _set_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = list(shingle_sets(part.column(1), k))
            whole = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            folded = pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), whole, folded], ["doc_id", "shingles", "folded"])


class _Links:
    """Finds links among candidate pairs (u < v) of class representatives."""

    def __init__(self, found: DataFrame, sets: DataFrame, percent: int):
        self.found, self.sets, self.percent = found, sets, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those whose set sizes allow the similarity and whose signatures agree."""
        side = lambda p, s: self.found.select(F.col("doc_id").alias(p), F.col("n_shingles").alias(f"n{p}"), F.col("signature").alias(s))
        percent = self.percent
        fits = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
        both = pairs.join(side("u", "sa"), "u").join(side("v", "sb"), "v").filter(fits)
        return map_arrow(both, lambda it: _agreeing(it, percent), "u long, v long")

    def confirmed(self, likely: DataFrame) -> DataFrame:
        """Those whose full sets have the similarity."""
        side = lambda p, s: self.sets.select(F.col("doc_id").alias(p), F.col("shingles").alias(s))
        both = likely.join(side("u", "a"), "u").join(side("v", "b"), "v")
        common = F.size(F.array_intersect("a", "b"))
        return cut(both.filter(100 * common >= self.percent * (F.size("a") + F.size("b") - common)).select("u", "v"))


def _outsiders(members: DataFrame, component: DataFrame) -> DataFrame:
    """Members of buckets of three or more that span components, with n, n_out, and whether each is outside its pivot's."""
    placed = members.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(
        F.count("*").alias("n"), F.min_by("component", "doc_id").alias("main"), F.min("component").alias("least"), F.max("component").alias("most"),
        F.min_by(F.struct("doc_id", "component"), F.xxhash64("doc_id", "key")).alias("other"),
    )
    return cut(placed.join(mixed.filter("least < most and n > 2"), "key").select("key", "doc_id", "component", (F.col("component") != F.col("main")).alias("outsider"), "n", "other"))


def _apart(x: DataFrame) -> DataFrame:
    """Distinct pairs (u < v) of x and y that lie in different components."""
    return x.filter("cx <> cy").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Two documents are linked if 100 * (common shingles) >= percent * (shingles of either).  The
    component is the smallest doc_id reached over links; kept marks the document that bears it.  A null,
    empty or blank text has no shingles and links with nothing.  A row without doc_id is its own,
    kept, with a null component.  Rows that share a doc_id count as one document.  Columns other
    than doc_id and the text take no part; an empty table gives an empty result.
    """
    found = cut(features(docs, text, k))
    known = found.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = known.select("doc_id", "f1", "f2", "n_shingles", "bands").join(
        classes.select("f1", "f2", "n_shingles", F.col("rep").alias("doc_id")), ["doc_id", "f1", "f2", "n_shingles"], "left_semi"
    )
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).filter("pivot < last").drop("last")
    members = cut(banded.join(shared, "key"))
    release(docs.sparkSession)
    concerned = members.select("doc_id").distinct()
    sets = cut(map_arrow(_source(docs, text).join(concerned, "doc_id", "left_semi"), lambda it: _set_batches(it, k), "doc_id long, shingles array<long>, folded binary").dropDuplicates(["doc_id"]))
    release(docs.sparkSession)
    marks = known.join(concerned, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n_shingles", "signature", "bands")
    links = _Links(cut(marks), sets, percent)
    tested = cut(members.filter("doc_id <> pivot").select(F.col("pivot").alias("u"), F.col("doc_id").alias("v")).distinct())
    edges = links.confirmed(links.likely(tested))
    component = connected_components(edges)
    members = members.select("key", "doc_id")
    release(docs.sparkSession)

    placed = _outsiders(members, component)
    if placed.head(1):
        outer = placed.filter("outsider").select("key", F.col("doc_id").alias("x"), F.col("component").alias("cx"), F.col("other.doc_id").alias("y"), F.col("other.component").alias("cy"))
        beside = outer.groupBy("key").agg(F.min_by(F.struct(F.col("x").alias("y"), F.col("cx").alias("cy")), F.xxhash64("x", "key")).alias("p"))
        beside = outer.drop("y", "cy").join(beside, "key").select("key", "x", "cx", "p.y", "p.cy")
        pairs = cut(_apart(outer.unionByName(beside)).join(tested, ["u", "v"], "left_anti"))
        more = links.confirmed(links.likely(pairs))
        tested, edges = tested.unionByName(pairs), edges.unionByName(more)
        component = connected_components(edges)
        placed = _outsiders(members, component)
    if placed.head(1):
        release(docs.sparkSession)
        sized = placed.groupBy("key").agg(F.count_if("outsider").alias("n_out"))
        nu, nv = F.ceil(F.col("n_out") / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
        spread = placed.join(sized, "key").join(links.found, "doc_id").join(sets.select("doc_id", "folded"), "doc_id").withColumns({"nu": nu, "nv": nv})
        others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
        payload = ["key", "doc_id", "component", "n_shingles", "signature", "bands", "folded"]
        rows = spread.filter("outsider").select(*payload, own("nu").alias("bu"), others("nv").alias("bv"), F.lit(True).alias("outsider"))
        rows = rows.unionByName(spread.select(*payload, others("nu").alias("bu"), own("nv").alias("bv"), F.lit(False).alias("outsider")))
        dealt = rows.repartition("key", "bu", "bv").sortWithinPartitions("key", "bu", "bv")
        pairs = map_arrow(dealt, lambda it: _blocks(it, percent), "u long, v long").distinct().join(tested, ["u", "v"], "left_anti")
        more = links.confirmed(pairs)
        if more.head(1):
            component = connected_components(edges.unionByName(more))

    rows = found.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    rows = rows.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", linked.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents of which each group of near-duplicates keeps the one with the smallest doc_id.

    A doc_id on several rows stays once; rows without one all stay.
    """
    kept = near_duplicates(docs, text, k, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    names = docs.columns
    marked = docs.select(*(F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(names)))
    at = f"__c{names.index('doc_id')}"
    stay = marked.join(kept, F.col(at) == F.col("__kept"), "left_semi").dropDuplicates([at])
    return stay.unionByName(marked.filter(F.col(at).isNull())).select(*(F.col(f"__c{i}").alias(n) for i, n in enumerate(names)))
