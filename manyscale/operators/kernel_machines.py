"""Support vector machines with a Gaussian kernel, solved exactly by a cascade.

For every class the rows are dealt into parts of bounded size. Each part's problem is solved, only its support vectors go on, and
parts are merged and solved again until one is left. Where classes overlap, support vectors grow with the table, and a last part would
hold more of them than one task should: if those of all parts are more rows than ``FAN`` parts, the parts are merged by all tasks at
once instead (``_merged_at_once``), from the weights they were left with. Then all rows are held against that machine: rows that
contradict it go into the next round's parts together with its support vectors, and a round without any has solved the problem over the
whole table, up to the stated tolerance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyscale.functions import arrays
from manyscale.functions import batches as nb
from manyscale.operators.classify import class_labels
from manyscale.operators.decomposition import _with_vectors, table_width
from manyscale.plans import storage

PART_ROWS = 1024
FAN = 4
TOLERANCE = 1e-3
CACHE_VALUES = 16_000_000
#: Kernel values that are worked out at a time.
TILE_VALUES = 1_000_000
ROUNDS = 10
MOST_TASKS = 1024
#: Of a merge at once: rows that directions of the kernel are taken from, how many directions, numbers in their products, steps, steps without
#: a gain, tries of one step.
LANDMARKS = 1024
DIRECTIONS = 128
PRODUCTS = 4_000_000
STEPS = 50
PATIENCE = 10
TRIES = 100


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.exp(-gamma * np.maximum(square, 0.0))


def scores(x: np.ndarray, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray | float, gamma: float) -> np.ndarray:
    """``kernel(x, vectors) @ weights.T + bias``, a bounded number of kernel values at a time."""
    out = np.zeros((len(x), len(weights)))
    # The exponent is one product, so a tile is gone through as seldom as can be.
    left = np.column_stack([x, (x * x).sum(axis=1), np.ones(len(x))])
    step = int(TILE_VALUES ** 0.5)
    for j in range(0, len(vectors), step):
        v = vectors[j : j + step]
        right = np.ascontiguousarray(np.column_stack([2.0 * gamma * v, np.full(len(v), -gamma), -gamma * (v * v).sum(axis=1)]).T)
        w = np.ascontiguousarray(weights[:, j : j + step].T)
        for s in range(0, len(x), step):
            tile = left[s : s + step] @ right
            np.minimum(tile, 0.0, out=tile)
            out[s : s + step] += np.exp(tile, out=tile) @ w
    return out + bias


def solve(x: np.ndarray, y: np.ndarray, cost: float, gamma: float, tolerance: float = TOLERANCE, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights ``alpha`` and bias of one two-class problem, by steps on the pair of rows that gain most.

    The largest violation of the optimality conditions is at most ``tolerance`` in the end. Kernel rows are kept as far as memory allows.
    Weights to ``start`` from are used if their signed sum is zero.
    """
    n = len(y)
    if n == 0 or abs(y.sum()) == n:
        return np.zeros(n), float(y[0]) if n else 0.0
    kept: dict[int, np.ndarray] = {}
    squares = (x * x).sum(axis=1)

    def row(i: int) -> np.ndarray:
        if i not in kept:
            if (len(kept) + 1) * n > CACHE_VALUES:
                kept.clear()
            kept[i] = np.exp(-gamma * np.maximum(squares + squares[i] - 2.0 * (x @ x[i]), 0.0))
        return kept[i]

    alpha, slope = np.zeros(n), -np.ones(n)
    if start is not None and start.any() and abs(start @ y) < 1e-9 * cost:
        alpha = start.astype(float)
        held = np.flatnonzero(alpha > 0)
        slope += y * scores(x, x[held], (alpha * y)[held][None, :], 0.0, gamma)[:, 0]
    up, down = np.where(y > 0, alpha < cost, alpha > 0), np.where(y > 0, alpha > 0, alpha < cost)
    while True:
        score = -y * slope
        i = int(np.where(up, score, -np.inf).argmax())
        gap = score[i] - score
        if gap[down].max(initial=-np.inf) <= tolerance:
            break
        k = row(i)
        curve = np.maximum(2.0 - 2.0 * k, 1e-12)
        j = int(np.where(down & (gap > 0), gap * gap / curve, -np.inf).argmax())
        step = gap[j] / curve[j]
        # Both weights stay between 0 and the cost, and the signed sum stays as it is.
        room_i = cost - alpha[i] if y[i] > 0 else alpha[i]
        room_j = alpha[j] if y[j] > 0 else cost - alpha[j]
        step = min(step, room_i, room_j)
        alpha[i] = np.clip(alpha[i] + y[i] * step, 0.0, cost)
        alpha[j] = np.clip(alpha[j] - y[j] * step, 0.0, cost)
        slope += y * step * (k - row(j))
        for at in (i, j):
            up[at] = alpha[at] < cost if y[at] > 0 else alpha[at] > 0
            down[at] = alpha[at] > 0 if y[at] > 0 else alpha[at] < cost
    score = -y * slope
    free = (alpha > 0) & (alpha < cost)
    bias = score[free].mean() if free.any() else (score[up].max(initial=-np.inf) + score[down].min(initial=np.inf)) / 2
    return alpha, float(bias)


@dataclass
class KernelMachine:
    """One machine for each class against the others: ``sum_i weights[c, i] k(vectors[i], x) + bias[c]``."""

    classes: list
    ids: np.ndarray
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    gamma: float
    cost: float
    #: Rows that contradict the machine by more than twice the tolerance, and rounds of the cascade.
    violations: int
    rounds: int

    @property
    def n_bytes(self) -> int:
        return self.vectors.nbytes + self.weights.nbytes

    def decisions(self, df: DataFrame, x_col: str = "x", out: str = "decisions") -> DataFrame:
        """The rows with the decision value of every class."""
        gamma = self.gamma
        return _with_vectors(df, x_col, out, lambda x, v, w, b: scores(x, v, w, b, gamma), (self.vectors, self.weights, self.bias), self.n_bytes)

    def predict(self, df: DataFrame, x_col: str = "x") -> DataFrame:
        """The rows with a ``prediction`` column; the first of equal decisions wins."""
        scored = self.decisions(df, x_col, "_scores")
        best = F.array_position("_scores", F.array_max("_scores")).cast("int")
        return scored.withColumn("prediction", F.element_at(F.lit(self.classes), best)).drop("_scores")


def _cascade(rows: DataFrame, machines: int, parts: int, cost: float, gamma: float, tolerance: float, most: int | None = None) -> tuple[DataFrame, int]:
    """``(machine, part, point_id, x, sign, alpha, bias)``: support vectors of every class from ``rows(machine, part, point_id, x, sign)``, and
    the parts left, one unless the support vectors of a class are more than ``most``.

    Merged parts start from the weights they were left with.
    """

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("point_id")
        ids = nb.to_numpy(table.column("point_id"))
        # A support vector may come from a part and from the last round.
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        table = table.take(pa.array(first))
        x, y = nb.to_matrix(table.column("x")), nb.to_numpy(table.column("sign")).astype(float)
        start = nb.to_numpy(table.column("alpha")) if "alpha" in table.column_names else None
        alpha, bias = solve(x, y, cost, gamma, tolerance, start)
        held = np.flatnonzero(alpha > 0)
        kept = table.select(["machine", "part", "point_id", "x", "sign"]).take(pa.array(held))
        return kept.append_column("alpha", pa.array(alpha[held])).append_column("bias", pa.array(np.full(len(held), bias)))

    schema = T.StructType([*rows.select("machine", "part", "point_id", "x", "sign").schema.fields,
                           T.StructField("alpha", T.DoubleType()), T.StructField("bias", T.DoubleType())])

    def solved(dealt: DataFrame) -> DataFrame:
        # Parts are small tables that take long, so they are spread by number and not by bytes.
        return dealt.repartition(min(MOST_TASKS, 4 * machines * parts), "machine", "part").groupBy("machine", "part").applyInArrow(work, schema)

    found = storage.materialize(solved(rows))
    while parts > 1:
        if most is not None and (found.groupBy("machine").count().agg(F.max("count")).first()[0] or 0) > most:
            break
        parts = -(-parts // FAN)
        found = storage.materialize(solved(found.withColumn("part", (F.col("part") / FAN).cast("int"))))
    return found, parts


def _directions(rows: DataFrame, n: int, machines: int, gamma: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Landmarks and a projection, so that ``kernel(x, landmarks) @ projection`` has nearly the kernel as its products, and how heavy what is
    left of the kernel is: the mean of its eigenvalues over the table, weighted by themselves."""
    some = nb.to_matrix(rows.orderBy(F.xxhash64("point_id"), "point_id").limit(2 * LANDMARKS).select("x").toArrow().column("x"))
    marks, others = some[:LANDMARKS], some[LANDMARKS:] if len(some) > LANDMARKS + 1 else some
    size, turned = np.linalg.eigh(kernel(marks, marks, gamma))
    kept = np.flatnonzero(size > 1e-10 * size[-1])[::-1][: max(1, min(DIRECTIONS, int((PRODUCTS / machines) ** 0.5)))]
    projection = turned[:, kept] / np.sqrt(size[kept])
    z = kernel(others, marks, gamma) @ projection
    left = kernel(others, others, gamma) - z @ z.T
    own, m = np.maximum(np.diag(left), 1e-15), len(left)
    across = ((left ** 2).sum() - (own ** 2).sum()) / max(1, m * (m - 1))
    return marks, projection, float(((own ** 2).mean() + n * max(0.0, across)) / own.mean())


def _steered(look: Callable, at: np.ndarray, ridge: np.ndarray, active: list[int], close: float, even: float) -> bool:
    """Move ``at`` to where the slopes of the concave functions that ``look`` adds up are ``close`` to level, the last one to ``even``. Newton steps,
    halved until they gain; false if that did not get there."""
    value, slope, bend = look(at, ridge, active)
    for _ in range(TRIES):
        active = [c for c in active if np.abs(slope[c, :-1]).max(initial=0.0) > close or abs(slope[c, -1]) > even]
        if not active:
            return True
        way, stride, base = np.zeros_like(at), np.ones(len(at)), at.copy()
        for c in active:
            way[c] = np.linalg.solve(bend[c], slope[c])
            way[c] *= min(1.0, (1.0 + np.linalg.norm(base[c])) / np.linalg.norm(way[c]))
        gain = (slope * way).sum(axis=1)
        waiting = active
        while waiting:
            at[waiting] = base[waiting] + stride[waiting, None] * way[waiting]
            new = look(at, ridge, waiting)
            good = [c for c in waiting if new[0][c] >= value[c] + 1e-4 * stride[c] * gain[c] - 1e-12 * abs(value[c]) or stride[c] < 1e-6]
            for old, now in zip((value, slope, bend), new):
                old[good] = now[good]
            waiting = [c for c in waiting if c not in good]
            stride[waiting] /= 2
    return False


def _merged_at_once(rows: DataFrame, found: DataFrame, classes: list, n: int, width: int, cost: float, gamma: float, tolerance: float) -> KernelMachine | None:
    """Machines over all ``rows(point_id, x, own)`` from the weights in ``found``, one for each row and machine at most; None if they do not settle.

    Every row keeps its weights and its exact scores. A step changes all weights at once: the kernel is taken as products in a few directions
    and a ridge for the rest of it, and the changes that are best then depend on one number for each direction, which Newton steps find.
    What the changes do to the scores is worked out with the kernel itself, which decides about their length and about the end.
    """
    spark, m = rows.sparkSession, len(classes)
    cores = spark.sparkContext.defaultParallelism
    marks, projection, weight = _directions(rows, n, m, gamma)
    d, least = projection.shape[1], 0.1 * tolerance / cost
    basis = spark.sparkContext.broadcast((marks, np.ascontiguousarray(projection.T)))

    def unpacked(batch: pa.RecordBatch, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Vectors, signs, and weights and scores after a move of that length."""
        x, own = nb.to_matrix(batch.column("x")), nb.to_numpy(batch.column("own"))
        signs = np.where(own[:, None] == np.arange(1, m + 1)[None, :], 1.0, -1.0)
        alpha, score, move, change = (nb.to_matrix(batch.column(c)) for c in ("alpha", "score", "move", "change"))
        alpha = alpha + length * signs * move
        alpha = np.where(alpha < 1e-12 * cost, 0.0, np.where(alpha > (1 - 1e-12) * cost, cost, alpha))
        return x, signs, alpha, score + length * change

    def pull(x: np.ndarray, signs: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.column_stack([scores(x, *basis.value, 0.0, gamma), np.ones(len(x))])
        return z, score - signs

    def bounds(signs: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(signs > 0, -alpha, alpha - cost), np.where(signs > 0, cost - alpha, alpha)

    def added(state: DataFrame, count: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
        """``count`` sums over all rows, a few numbers from each core."""

        def task(it: Iterator[pa.RecordBatch]):
            total = np.zeros(count)
            for batch in it:
                if batch.num_rows:
                    add(batch, total)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        parts = state.coalesce(cores).mapInArrow(task, "total binary").collect()
        return np.sum([np.frombuffer(r.total) for r in parts], axis=0)

    def contrary(state: DataFrame, length: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Rows of every machine that violate its optimality, a little more strictly than ``contradictions`` has it."""

        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            _, signs, alpha, score = unpacked(batch, length)
            margin = signs * (score + bias)
            off = np.maximum(np.where(alpha < cost, 1.0 - margin, 0.0), np.where(alpha > 0, margin - 1.0, 0.0))
            total += (off > 1.9 * tolerance).sum(axis=0)

        return added(state, m, add)

    def aimed(state: DataFrame, length: np.ndarray) -> Callable:
        def look(at: np.ndarray, ridge: np.ndarray, active: list[int]) -> tuple[np.ndarray, ...]:
            """Value, slope and bend (negative) of the function whose top gives the best changes, for the active machines."""
            at, each = at.copy(), 1 + (d + 1) + (d + 1) ** 2

            def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
                x, signs, alpha, score = unpacked(batch, length)
                z, short = pull(x, signs, score)
                low, high = bounds(signs, alpha)
                for k, c in enumerate(active):
                    h = short[:, c] + z @ at[c]
                    move = np.clip(-h / ridge[c], low[:, c], high[:, c])
                    free = z[(move > low[:, c]) & (move < high[:, c])]
                    own = total[k * each : (k + 1) * each]
                    own[0] += (0.5 * ridge[c] * move * move + h * move).sum()
                    own[1 : d + 2] += z.T @ move
                    own[d + 2 :] += (free.T @ free).ravel() / ridge[c]

            sums = added(state, each * len(active), add).reshape(len(active), each)
            value, slope, bend = np.zeros(m), np.zeros((m, d + 1)), np.zeros((m, d + 1, d + 1))
            for own, c in zip(sums, active):
                inner = np.append(at[c, :d], 0.0)
                value[c], slope[c] = own[0] - 0.5 * inner @ inner, own[1 : d + 2] - inner
                bend[c] = own[d + 2 :].reshape(d + 1, d + 1) + np.diag(np.append(np.ones(d), 1e-6))
            return value, slope, bend

        return look

    def moved(state: DataFrame, move_of: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]]) -> DataFrame:
        """The rows with the moves that ``move_of`` tells, and what these change in the scores."""

        def movers(it: Iterator[pa.RecordBatch]):
            for batch in it:
                if batch.num_rows:
                    x, *_, move = move_of(batch)
                    at = np.flatnonzero(move.any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([v[at].tobytes()], pa.binary()) for v in (x, move)], names=["x", "move"])

        # The driver holds what it sends on once: views of the bytes that came.
        apart = state.mapInArrow(movers, "x binary, move binary").toArrow()
        pieces = [tuple(np.frombuffer(v.as_buffer()).reshape(-1, wide) for v, wide in zip(pair, (width, m))) for pair in zip(apart.column("x"), apart.column("move"))]
        shipped = storage.checked_broadcast(spark, pieces, sum(x.nbytes + move.nbytes for x, move in pieces), "the vectors whose weights change")
        del apart, pieces

        def task(it: Iterator[pa.RecordBatch]):
            for batch in it:
                if batch.num_rows:
                    x, alpha, score, move = move_of(batch)
                    change = np.zeros_like(move)
                    for vectors, weights in shipped.value:
                        change += scores(x, vectors, weights.T, 0.0, gamma)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in ("point_id", "x", "own")), *(nb.from_matrix(v) for v in (alpha, score, move, change))],
                        names=["point_id", "x", "own", "alpha", "score", "move", "change"])

        lists = ", ".join(f"{c} array<double>" for c in ("alpha", "score", "move", "change"))
        out = storage.materialize(state.mapInArrow(task, f"point_id long, x array<double>, own long, {lists}"))
        shipped.destroy()
        return out

    def begun(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        x, own, first = nb.to_matrix(batch.column("x")), nb.to_numpy(batch.column("own")), nb.to_matrix(batch.column("first"))
        none = np.zeros((len(x), m))
        return x, none, none, np.where(own[:, None] == np.arange(1, m + 1)[None, :], first, -first)

    held = found.groupBy("point_id").agg(F.map_from_entries(F.collect_list(F.struct("machine", "alpha"))).alias("held"))
    first = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0.0)))
    state = moved(storage.materialize(rows.join(held, "point_id", "left").select("point_id", "x", "own", first.alias("first")).repartition(4 * cores, "point_id")), begun)
    length, at = np.ones(m), np.zeros((m, d + 1))
    at[:, d] = [b or 0.0 for _, b in sorted(found.groupBy("machine").agg(F.avg("bias")).collect())] if found.select("machine").distinct().count() == m else 0.0
    ridge = np.full(m, max(weight, least))
    active, fewest, gained = list(range(m)), np.inf, 0
    for step in range(STEPS + 1):
        against = contrary(state, length, at[:, d])
        active = [c for c in active if against[c]]
        if not active:
            break
        if against[active].sum() < 0.9 * fewest:
            fewest, gained = against[active].sum(), step
        if step == STEPS or step - gained >= PATIENCE:
            return None
        at[:, :d] = 0.0
        look = aimed(state, length)
        # The first step goes far, so it is found by way of heavier ridges, under which few weights are at their bounds.
        by_way = 8.0 ** np.arange(max(0, int(np.ceil(np.log(1 / cost / ridge.min()) / np.log(8.0)))), -1, -1) if step == 0 else [1.0]
        for factor in by_way:
            if not _steered(look, at, ridge * factor, active, 1e-4 * tolerance, 1e-9 * cost):
                return None
        aim, heavy, before, going = at.copy(), ridge.copy(), length.copy(), np.isin(np.arange(m), active)

        def best(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            x, signs, alpha, score = unpacked(batch, before)
            z, short = pull(x, signs, score)
            return x, alpha, score, np.where(going, np.clip(-(short + z @ aim.T) / heavy, *bounds(signs, alpha)), 0.0)

        state = moved(state, best)

        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            _, signs, _, score = unpacked(batch, np.zeros(m))
            move, change = nb.to_matrix(batch.column("move")), nb.to_matrix(batch.column("change"))
            total += np.concatenate([((score - signs) * move).sum(axis=0), (move * change).sum(axis=0), (move * move).sum(axis=0)])

        line, curve, square = added(state, 3 * m, add).reshape(3, m)
        whole = np.divide(-line, curve, out=np.ones(m), where=curve > 0)
        length = np.where(whole >= 0.5, 1.0, np.maximum(whole, 0.0))
        # What the rest of the kernel weighed along the changes.
        rest = 1.5 * np.divide(curve - (aim[:, :d] ** 2).sum(axis=1), square, out=np.zeros(m), where=square > 0)
        ridge = np.where(going, np.maximum(np.where(whole >= 0.5, rest, np.maximum(2 * ridge, rest)), least), ridge)

    def result(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows:
                x, signs, alpha, _ = unpacked(batch, length)
                at = np.flatnonzero(alpha.any(axis=1))
                ids = nb.to_numpy(batch.column("point_id")).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v[at].tobytes()], pa.binary()) for v in (ids, x, signs * alpha)], names=["point_id", "x", "weights"])

    apart = state.mapInArrow(result, "point_id binary, x binary, weights binary").toArrow()
    basis.destroy()
    ids = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in apart.column("point_id")])
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids)] = np.arange(len(ids))
    vectors, weights, done = np.empty((len(ids), width)), np.empty((m, len(ids))), 0
    for x, held in zip(apart.column("x"), apart.column("weights")):
        x, held = np.frombuffer(x.as_buffer()).reshape(-1, width), np.frombuffer(held.as_buffer()).reshape(-1, m)
        to = place[done : done + len(x)]
        vectors[to], weights[:, to], done = x, held.T, done + len(x)
    return KernelMachine(classes, np.sort(ids), vectors, weights, at[:, d].copy(), gamma, cost, 0, 1)


def fit_kernel_machine(train: DataFrame, *, cost: float = 1.0, gamma: float | None = None, part_rows: int = PART_ROWS, tolerance: float = TOLERANCE,
                       rounds: int = ROUNDS, key: str = "point_id") -> KernelMachine:
    """Fit on ``(point_id, x, label)``; ``gamma`` is one over the width unless given. Ids are unique."""
    classes = class_labels(train)
    rows = train.select(F.col(key).cast("long").alias("point_id"), arrays.doubles("x").alias("x"), F.array_position(F.lit(classes), F.col("label")).alias("own"))
    rows = storage.materialize(rows)
    width, n = table_width(rows), rows.count()
    gamma = 1.0 / width if gamma is None else gamma
    parts = max(1, -(-n // part_rows))
    machines = F.explode(F.sequence(F.lit(0), F.lit(len(classes) - 1)))
    each = rows.withColumn("machine", machines).select(
        "machine", F.pmod(F.xxhash64("point_id", "machine"), F.lit(parts)).cast("int").alias("part"), "point_id", "x",
        F.when(F.col("own") == F.col("machine") + 1, 1).otherwise(-1).alias("sign"))
    work, model = each, None
    for turn in range(1, rounds + 1):
        found, left = _cascade(work, len(classes), parts, cost, gamma, tolerance, FAN * part_rows if turn == 1 else None)
        model = _merged_at_once(rows, found, classes, n, width, cost, gamma, tolerance) if left > 1 else None
        if left > 1 and model is None:
            found, left = _cascade(work, len(classes), parts, cost, gamma, tolerance)
        if model is None:
            # A row may support several machines; its vector is fetched once.
            apart = found.select("point_id", "x").dropDuplicates(["point_id"]).toArrow().sort_by("point_id")
            ids, vectors = nb.to_numpy(apart.column("point_id")), nb.to_matrix(apart.column("x")).reshape(-1, width)
            weights, bias = np.zeros((len(classes), len(ids))), np.zeros(len(classes))
            held = found.select("machine", "point_id", "sign", "alpha", "bias").toArrow()
            machine, point, sign, alpha, level = (nb.to_numpy(held.column(c)) for c in held.column_names)
            weights[machine, np.searchsorted(ids, point)] = alpha * sign
            bias[machine] = level
            model = KernelMachine(classes, ids, vectors, weights, bias, gamma, cost, 0, turn)
        against = storage.materialize(contradictions(rows, model, tolerance))
        model.violations = against.count()
        if model.violations == 0:
            break
        if left > 1:
            found = supports(rows, model)
        fresh = against.select("machine", "point_id", "x", "sign")
        parts = max(1, -(-model.violations // (part_rows * len(classes))))
        dealt = fresh.withColumn("part", F.pmod(F.xxhash64("point_id"), F.lit(parts)).cast("int"))
        every = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        columns = ["machine", "part", "point_id", "x", "sign"]
        work = dealt.select(columns).unionByName(every.select(columns))
    return model


def supports(rows: DataFrame, model: KernelMachine) -> DataFrame:
    """``(machine, point_id, x, sign)``: the support vectors of every machine among rows ``(point_id, x, own)``."""
    shipped = storage.checked_broadcast(rows.sparkSession, (model.ids, model.weights), model.n_bytes, "the support vectors")

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            ids, weights = shipped.value
            own = nb.to_numpy(batch.column("point_id"))
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            machine, row = np.nonzero(np.where(ids[at] == own, weights[:, at], 0.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(machine, pa.int32()), *(batch.column(c).take(pa.array(row)) for c in ("point_id", "x")), pa.array(np.sign(weights[machine, at[row]]), pa.int32())],
                names=["machine", "point_id", "x", "sign"])

    return rows.mapInArrow(task, "machine int, point_id long, x array<double>, sign int")


def contradictions(rows: DataFrame, model: KernelMachine, tolerance: float = TOLERANCE) -> DataFrame:
    """``(machine, point_id, x, sign, off)``: rows ``(point_id, x, own)`` that violate a machine's optimality by more than twice the tolerance."""
    shipped = storage.checked_broadcast(rows.sparkSession, model, model.n_bytes, "the support vectors")

    def task(it: Iterator[pa.RecordBatch]):
        for batch in it:
            if batch.num_rows == 0:
                continue
            m = shipped.value
            ids, x, own = nb.to_numpy(batch.column("point_id")), nb.to_matrix(batch.column("x")), nb.to_numpy(batch.column("own")) - 1
            signs = np.where(own[:, None] == np.arange(len(m.classes))[None, :], 1, -1)
            margin = signs * scores(x, m.vectors, m.weights, m.bias, m.gamma)
            at = np.minimum(np.searchsorted(m.ids, ids), max(0, len(m.ids) - 1))
            alpha = np.where((m.ids[at] == ids)[:, None], np.abs(m.weights[:, at].T), 0.0) if len(m.ids) else np.zeros(margin.shape)
            off = np.maximum(np.where(alpha < m.cost, 1.0 - margin, 0.0), np.where(alpha > 0, margin - 1.0, 0.0))
            row, machine = np.nonzero(off > 2 * tolerance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(machine, pa.int32()), pa.array(ids[row]), nb.from_matrix(x[row]), pa.array(signs[row, machine], pa.int32()), pa.array(off[row, machine])],
                names=["machine", "point_id", "x", "sign", "off"])

    return rows.mapInArrow(task, "machine int, point_id long, x array<double>, sign int, off double")


def kernel_svm(train: DataFrame, test: DataFrame, **options) -> DataFrame:
    """The rows of ``test`` with the ``prediction`` of an exact machine."""
    return fit_kernel_machine(train, **options).predict(test)
