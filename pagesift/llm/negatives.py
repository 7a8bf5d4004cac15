"""Hard negatives by segment summaries.

1. Vectors become integers. Each is cut into SEGMENTS pieces; a piece's mean and deviation (root of
   the sum of squared differences from the mean) are stored beside the vector.
2. The inner product of two pieces is the product of their means times their length, plus at most,
   or minus at most, the product of their deviations. Summed over the pieces this bounds a score.
   Halves, quarters and so on are merged from the stored pieces: one piece bounds all pairs, the
   pairs that may still count are bounded by two pieces, then four, and so on; the rest is scored
   exactly.
3. Rows are dealt out by hash into groups of bounded size. A copy of each anchor goes to each group
   (the stated query set against all rows, in blocks); a task first reads the rows of its group,
   then the anchors in batches. What the groups find is ranked per anchor.
4. The positives come first. Their scores give the ranges in which the negatives are sought the
   same way.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.llm.scratch import Scratch

POSITIVES, NEGATIVES = 5, 10
#: bounds of a negative's score, in hundredths of the positive's
LOW, HIGH = 30, 90
SEGMENTS = 8
#: bytes of a group's numbers, and the least number of groups
GROUP_BYTES, GROUPS = 32 * 1024 * 1024, 16
#: anchors compared with a group at a time
ANCHORS = 64


def segment_bounds(size: int) -> np.ndarray:
    """Where the pieces of a vector begin, and its end; pieces may be empty."""
    return np.arange(SEGMENTS + 1) * size // SEGMENTS


def summaries(values: np.ndarray) -> np.ndarray:
    """(rows, 2 * SEGMENTS): means, then deviations, of each row's pieces."""
    bounds = segment_bounds(values.shape[1])
    found = np.zeros((len(values), 2 * SEGMENTS))
    for n, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        if high > low:
            piece = values[:, low:high].astype(np.float64)
            mean = piece.mean(1)
            found[:, n] = mean
            found[:, SEGMENTS + n] = np.sqrt(((piece - mean[:, None]) ** 2).sum(1))
    return found


def merged(summary: np.ndarray, size: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Means, times the root of their lengths, and deviations of fewer, longer pieces."""
    lengths = np.diff(segment_bounds(size)).astype(np.float64).reshape(pieces, -1)
    mean = summary[:, :SEGMENTS].reshape(len(summary), pieces, -1)
    squares = summary[:, SEGMENTS:].reshape(len(summary), pieces, -1) ** 2
    total = np.maximum(lengths.sum(1), 1)
    whole = (mean * lengths).sum(2) / total
    spread = squares.sum(2) + (lengths * (mean - whole[:, :, None]) ** 2).sum(2)
    return whole * np.sqrt(total), np.sqrt(spread)


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of both; as products of doubles where these are exact."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0))
    if largest * left.shape[1] < 2**53:
        return (left @ right.T).astype(np.int64)
    # Python's integers, for components beyond any usual embedding
    whole = [[[int(x) for x in row] for row in side] for side in (left, right)]
    return np.array([[sum(map(operator.mul, a, b)) for b in whole[1]] for a in whole[0]], np.int64)


def _first(chosen: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, count: int):
    """(anchor place, row place, score) of each anchor's first `count` chosen: higher scores first, then
    smaller ids."""
    at, places = np.nonzero(chosen & (scores >= _kth(chosen, scores, count)))
    found = scores[at, places]
    order = np.lexsort((ids[rows[places]], -found, at))
    own = at[order]
    order = order[np.arange(len(order)) - np.searchsorted(own, own) < count]
    return at[order], rows[places[order]], found[order]


class Group:
    """The rows of a group."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, summary: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values
        self.size = values.shape[1]
        self.levels = []
        pieces = 1
        while pieces <= SEGMENTS:
            self.levels.append((pieces, *merged(summary, self.size, pieces)))
            pieces *= 2

    def bounded(self, summary: np.ndarray, wanted: Callable, chosen: np.ndarray):
        """The rows that an anchor still wants after all levels, and (anchors, such rows) which pairs.
        `chosen` (anchors, rows) says which pairs count, `wanted(chosen, lower, upper)` which of these bounds
        may still count. A level bounds the rows that the one before left."""
        rows = np.arange(len(self.ids))
        for pieces, mean, spread in self.levels:
            own_mean, own_spread = merged(summary, self.size, pieces)
            middle, reach = own_mean @ mean[rows].T, own_spread @ spread[rows].T
            # more than rounding can add
            reach = reach * (1 + 1e-9) + 1e-9 * np.abs(middle) + 1e-6
            chosen = chosen & wanted(chosen, middle - reach, middle + reach)
            left = chosen.any(axis=0)
            rows, chosen = rows[left], chosen[:, left]
        return rows, chosen


def _kth(chosen: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The `count`-th largest chosen value of each row, as a column; minus infinity where there are fewer."""
    if not count or chosen.shape[1] < count or chosen.sum(axis=1).max(initial=0) < count:
        return np.full((len(chosen), 1), -np.inf)
    own = np.where(chosen, values, -np.inf)
    return np.partition(own, own.shape[1] - count, axis=1)[:, own.shape[1] - count, None]


def positives_of(group: Group, ids, labels, values, summary, count: int):
    """(anchor place, row place, score) of each anchor's best rows of its label in the group."""
    chosen = (labels[:, None] == group.labels[None, :]) & (ids[:, None] != group.ids[None, :])

    def wanted(chosen, lower, upper):
        return upper >= _kth(chosen, lower, count)

    rows, chosen = group.bounded(summary, wanted, chosen)
    scores = exact_scores(values, group.values[rows])
    return _first(chosen, scores, group.ids, rows, count)


def negatives_of(group: Group, labels, values, summary, positives: np.ndarray, count: int):
    """(anchor place, positive's place, row place, score) of the best rows of other labels in the range of
    each positive's score. `positives` is (anchors, places) of scores, not a number where there is none."""
    chosen = labels[:, None] != group.labels[None, :]
    low, high = LOW * positives / 100, HIGH * positives / 100

    def wanted(chosen, lower, upper):
        stays = np.zeros(chosen.shape, bool)
        for k in range(positives.shape[1]):
            below, above = low[:, k, None], high[:, k, None]
            may = chosen & (lower <= above) & (upper >= below)
            # rows that are in the range for certain
            least = _kth(may & (lower >= below) & (upper <= above), lower, count)
            stays |= may & (upper >= least)
        return stays

    rows, chosen = group.bounded(summary, wanted, chosen)
    scores = exact_scores(values, group.values[rows])
    found = []
    for k in range(positives.shape[1]):
        there = np.isfinite(positives[:, k, None])
        exact = np.where(there, positives[:, k, None], 0).astype(np.int64)
        inside = chosen & there & (LOW * exact <= 100 * scores) & (100 * scores <= HIGH * exact)
        at, row, score = _first(inside, scores, group.ids, rows, count)
        found.append((at, np.full(len(at), k), row, score))
    return tuple(np.concatenate(column) for column in zip(*found))


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the summaries to (vec_id, label, size, numbers)."""
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        numbers = batch.column(3)
        flat, offsets = numbers.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        found = np.zeros((batch.num_rows, 2 * SEGMENTS))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            values = flat[offsets[rows][:, None] + np.arange(size)[None, :]]
            found[rows] = summaries(values)
        summary = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), 2 * SEGMENTS)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, summary.cast(pa.list_(pa.float64()))], [*batch.schema.names, "summary"]
        )


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def prepared(vectors: DataFrame, relabelled: Column) -> DataFrame:
    """(vec_id, label, size, numbers, summary, grp) of the rows that take part."""
    label = F.col("label").cast("long")
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).filter(
        "vec_id is not null and label is not null and vector is not null and size(vector) > 0 "
        "and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("kept"))
    rows = one.select("vec_id", "kept.label", "kept.vector").select(
        "vec_id",
        F.when(relabelled, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.size("vector").cast("long").alias("size"),
        F.transform("vector", lambda x: F.floor(x * 256).cast("double")).alias("numbers"),
    )
    shape = "vec_id long, label long, size long, numbers array<double>, summary array<double>"
    return rows.mapInArrow(_prepared, shape)


def _dealt(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Rows and anchors per group and vector size, each group's rows before its anchors."""
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    columns = ["size", "grp", "kind", "vec_id", "label", "numbers", "summary", "positives"]
    none = F.lit(None).cast("array<long>")
    both = (
        rows.withColumns({"grp": group, "kind": F.lit(0), "positives": none})
        .select(*columns)
        .unionByName(
            anchors.select("*", copies).withColumn("kind", F.lit(1)).select(*columns)
        )
    )
    return both.repartition("size", "grp").sortWithinPartitions("size", "grp", "kind", "vec_id")


def _searcher(count: int, negative: bool):
    """For each group of the stream: the rows are gathered, the anchors compared batch by batch."""

    def compared(group: Group | None, part: pa.Table) -> pa.RecordBatch | None:
        if group is None:
            return None
        ids, labels = part["vec_id"].to_numpy(), part["label"].to_numpy()
        values, summary = (_matrix(part[c].combine_chunks()) for c in ("numbers", "summary"))
        if not negative:
            at, rows, scores = positives_of(group, ids, labels, values, summary, count)
            columns = [ids[at], group.ids[rows], scores]
            names = ["anchor_id", "vec_id", "score"]
        else:
            listed = part["positives"].to_pylist()
            # exact as doubles, and checked as integers
            positives = np.full((len(listed), POSITIVES), np.nan)
            for n, own in enumerate(listed):
                positives[n, : len(own)] = own
            at, place, rows, scores = negatives_of(group, labels, values, summary, positives, count)
            columns = [ids[at], place, group.ids[rows], scores]
            names = ["anchor_id", "place", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, gathered = None, None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.stack([table[c].to_numpy() for c in ("size", "grp", "kind")], 1)
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for low, high in zip([0, *edges], [*edges, len(keys)]):
                part = table.slice(low, high - low)
                size, number, kind = keys[low].tolist()
                if (size, number) != key:
                    key, group, gathered = (size, number), None, []
                if kind == 0:
                    gathered.append(part)
                    continue
                if group is None and gathered:
                    rows = pa.concat_tables(gathered).combine_chunks()
                    numbers, summary = (_matrix(rows[c].combine_chunks()) for c in ("numbers", "summary"))
                    group = Group(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), numbers, summary)
                    gathered = []
                for first in range(0, part.num_rows, ANCHORS):
                    found = compared(group, part.slice(first, ANCHORS))
                    if found is not None:
                        yield found

    return run


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    relabelled: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` has vec_id, embedding and label (others ignored). `anchors` is a condition on vec_id;
    rows under `relabelled`, also on vec_id, get the label (label + 1) % 10. A row's score is the inner
    product of floor(256 * x) with the anchor's; higher ones come first, ties by smaller vec_id. Positives are
    the first `positives` other rows of the anchor's label; for each of them the first `negatives`
    rows of other labels whose score is from LOW to HIGH hundredths of its own are returned.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take
    no part. Of rows that repeat a vec_id, one takes part: the smallest label, then vector. Vectors
    of different lengths are not compared. Anchors without positives, or positives without
    negatives, have no rows; an empty table gives none.
    """
    if positives > POSITIVES:
        raise ValueError(f"at most {POSITIVES} positives")
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.store(prepared(vectors, relabelled), "rows")
    total = rows.agg(F.sum("size").alias("numbers")).first()["numbers"] or 0
    groups = max(GROUPS, -(-8 * total // group_bytes))
    own = rows.filter(anchors)
    none = F.lit(None).cast("array<long>")
    found = _dealt(rows, own.withColumn("positives", none), groups).mapInArrow(
        _searcher(positives, False), "anchor_id long, vec_id long, score long"
    )
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = scratch.store(
        found.withColumn("place", F.row_number().over(by_score) - 1).filter(
            F.col("place") < positives
        ),
        "positives",
    )
    listed = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        # at most `positives` of them
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]
        ).alias("positives")
    )
    found = _dealt(rows, own.join(listed, "vec_id"), groups).mapInArrow(
        _searcher(negatives, True), "anchor_id long, place long, vec_id long, score long"
    )
    by_score = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(
        F.col("rank") <= negatives
    )
    result = scratch.store(
        ranked.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), ["anchor_id", "place"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
        "result",
    )
    scratch.close(result)
    return result


NEGATIVES_SQL = """
with usable as (
  select vec_id, label::bigint as label, list_transform(embedding, lambda x: floor(x::double * 256)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), rows_ as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from usable
), scored as (
  select a.vec_id as anchor_id, r.vec_id, a.label = r.label as alike,
    list_inner_product(a.v, r.v)::bigint as score
  from rows_ a join rows_ r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id,
  row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as "rank",
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.alike
  and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify "rank" <= 10
"""
