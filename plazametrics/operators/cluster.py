"""K-means, k-medoids, silhouettes and archetypes over vector rows.

Every iteration is one pass over the rows; all restarts and all ``k`` share the pass. Restarts
of k-means over few numbers run apart, each on all rows in one task. The driver holds centres
and ``k``-sized sums, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import block_sums, distances, plain_distances, stack
from .moments import added
from .resident import fits, on_all_rows
from .simplex import convex_weights, project_rows


@dataclass
class Run:
    """One restart: its number of groups, seed and current centres."""

    k: int
    seed: int
    centres: np.ndarray
    ids: list | None = None
    done: bool = False


def starting_rows(df: DataFrame, row_id: str, vector: str, draws: Sequence[tuple[int, int]]) -> list[list[tuple]]:
    """For each draw (rows, seed) its own random sample of all rows: those with the least hash of (rows, seed, id).

    One pass serves all draws. A partition sends its least rows of each draw, and the least of these are kept.
    """
    hashes = F.array(*[F.xxhash64(F.lit(n), F.lit(seed), row_id) for n, seed in draws])
    types = dict(df.dtypes)

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame] = [pd.DataFrame()] * len(draws)
        for pdf in batches:
            table = np.asarray(pdf["_h"].tolist(), dtype="int64").reshape(len(pdf), -1)
            for d, (n, _) in enumerate(draws):
                # Ids may be of any type that sorts; only rows whose hash can be among the least are sorted by id.
                own = table[:, d]
                fits = own <= np.partition(own, n - 1)[n - 1] if n < len(own) else np.ones(len(own), bool)
                mine = pdf.loc[fits, [row_id, vector]].assign(draw=d, hash=own[fits])
                best[d] = pd.concat([best[d], mine]).sort_values(["hash", row_id]).head(n)
        for part in best:
            if len(part):
                yield part[["draw", "hash", row_id, vector]]

    schema = f"draw int, hash bigint, `{row_id}` {types[row_id]}, `{vector}` {types[vector]}"
    found = df.select(row_id, vector, hashes.alias("_h")).mapInPandas(least, schema)
    place = F.row_number().over(Window.partitionBy("draw").orderBy("hash", row_id))
    wanted = F.element_at(F.array(*[F.lit(n) for n, _ in draws]), F.col("draw") + 1)
    out: list[list[tuple]] = [[] for _ in draws]
    for row in found.withColumn("_place", place).where(F.col("_place") <= wanted).orderBy("draw", "_place").collect():
        out[row["draw"]].append((row[row_id], row[vector]))
    return out


def random_starts(df: DataFrame, row_id: str, vector: str, ks: Sequence[int], seeds: Sequence[int]) -> list[Run]:
    draws = [(k, seed) for k in ks for seed in seeds]
    return [
        Run(k, seed, np.asarray([v for _, v in picked], dtype="float64"), [i for i, _ in picked])
        for (k, seed), picked in zip(draws, starting_rows(df, row_id, vector, draws))
    ]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return plain_distances(x, centres).argmin(axis=1)


def group_sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Sums and, last, number of the rows nearest to each centre."""
    padded = np.hstack([x, np.ones((len(x), 1))])
    cells = nearest(x, centres)[:, None] * padded.shape[1] + np.arange(padded.shape[1])
    return np.bincount(cells.ravel(), padded.ravel(), len(centres) * padded.shape[1]).reshape(len(centres), -1)


def lloyd_step(df: DataFrame, vector: str, runs: Sequence[Run]) -> list[np.ndarray]:
    """One assign-and-average pass for every run; an empty group keeps its centre."""
    live = [(i, r.centres) for i, r in enumerate(runs) if not r.done]
    width = live[0][1].shape[1] if live else 0
    names = [f"s{j}" for j in range(width)] + ["held"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {i: np.zeros((len(c), c.shape[1] + 1)) for i, c in live}
        for pdf in batches:
            x = stack(pdf[vector])
            for i, centres in live:
                totals[i] += group_sums(x, centres)
        keys = [(i, g) for i, total in totals.items() for g in range(len(total))]
        table = np.concatenate(list(totals.values()))
        out = pd.DataFrame(keys, columns=["run", "label"]).join(pd.DataFrame(table, columns=names))
        yield out[out["held"] > 0]

    updated = [r.centres.copy() for r in runs]
    if not live:
        return updated
    parts = df.select(vector).mapInPandas(sums, "run int, label int, " + ", ".join(f"{c} double" for c in names))
    # One column a number: a single shuffle adds them, and steps of little arithmetic are mostly the start of stages.
    for run, label, *total, held in parts.groupBy("run", "label").agg(*[F.sum(c) for c in names]).collect():
        updated[run][label] = np.asarray(total) / held
    return updated


def kmeans(
    df: DataFrame, row_id: str, vector: str, ks: Sequence[int] = range(2, 7), seeds: Sequence[int] = range(25),
    iterations: int = 300,
) -> list[Run]:
    """Lloyd's algorithm for every (k, seed) until the centres stand still."""
    runs = random_starts(df, row_id, vector, list(ks), list(seeds))
    if runs and runs[0].centres.size and fits(df.count(), runs[0].centres.shape[1]):
        return lloyd_runs(df, row_id, vector, runs, iterations)
    for _ in range(iterations):
        if all(r.done for r in runs):
            break
        for run, centres in zip(runs, lloyd_step(df, vector, runs)):
            run.done = run.done or np.allclose(centres, run.centres)
            run.centres = centres
    return runs


def lloyd_runs(df: DataFrame, row_id: str, vector: str, runs: list[Run], iterations: int) -> list[Run]:
    """All steps of each run in the task that has drawn it."""
    starts = [(i, r.centres) for i, r in enumerate(runs)]

    def steps(rows: pd.DataFrame, own: Sequence[tuple[int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        x = stack(rows.sort_values(row_id)[vector])
        for i, centres in own:
            done = False
            for _ in range(iterations):
                if done:
                    break
                total = group_sums(x, centres)
                held = total[:, -1:]
                moved = np.where(held > 0, total[:, :-1] / np.maximum(held, 1), centres)
                done, centres = np.allclose(moved, centres), moved
            yield pd.DataFrame({"run": [i], "done": [done], "centres": [centres.ravel()]})

    found = on_all_rows(df, [row_id, vector], starts, steps, "run int, done boolean, centres array<double>")
    for row in found.collect():
        run = runs[row["run"]]
        run.centres, run.done = np.asarray(row["centres"]).reshape(run.centres.shape), row["done"]
    return runs


def label_runs(df: DataFrame, row_id: str, vector: str, runs: Sequence[Run], keep: Sequence[str] = ()) -> DataFrame:
    """Append ``labels``: the nearest centre's number in each run."""
    centres = [r.centres for r in runs]
    types = dict(df.dtypes)
    columns = [row_id, vector, *keep]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = stack(pdf[vector])
            labels = np.stack([nearest(x, c) for c in centres], axis=1)
            yield pdf.assign(labels=list(labels.astype("int32")))

    schema = ", ".join([f"{c} {types[c]}" for c in columns] + ["labels array<int>"])
    return df.select(*columns).mapInPandas(assign, schema)


class Marks:
    """Group numbers of several runs as columns of one table, a run's groups beside each other."""

    def __init__(self, groups: Sequence[int]):
        self.offsets = np.concatenate([[0], np.cumsum(groups)]).astype(int)
        self.width = int(self.offsets[-1])

    def own(self, labels: pd.Series) -> np.ndarray:
        """The column of each row's group in each run."""
        return stack(labels).astype(int) + self.offsets[:-1]

    def table(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros((len(own), self.width))
        out[np.arange(len(own))[:, None], own] = 1.0
        return out


def silhouettes(labelled: DataFrame, row_id: str, vector: str, labels: str, groups: Sequence[int], **sizing) -> DataFrame:
    """Mean Euclidean silhouette per run (rows alone in their group are left out).

    ``labels`` holds one group number per run and ``groups`` the number of groups of each.
    Block pairs send per-row distance sums per group, so no pair leaves a task. The sizes of the
    groups are counted once.
    """
    groups = list(groups)
    marks = Marks(groups)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(marks.width)
        for pdf in batches:
            total += marks.table(marks.own(pdf[labels])).sum(axis=0) if len(pdf) else 0.0
        yield pd.DataFrame({"sums": [total]})

    sizes = added(labelled.select(labels).mapInPandas(counted, "sums array<double>"), []).get((), np.zeros(marks.width))

    def prepare(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return stack(pdf[vector]), marks.own(pdf[labels])

    def kernel(left: Sequence[np.ndarray], right: Sequence[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
        d = distances(left[0], right[0])
        first = d @ marks.table(right[1])
        return first, first if same else d.T @ marks.table(left[1])

    def score(rows: pd.DataFrame, sums: np.ndarray, times: np.ndarray) -> pd.DataFrame:
        total, count = np.zeros(len(groups)), np.zeros(len(groups))
        own_groups, rows_at = marks.own(rows[labels]), np.arange(len(rows))
        for run in range(len(groups)):
            part = slice(marks.offsets[run], marks.offsets[run + 1])
            gs, gn, own = sums[:, part], times[:, None] * sizes[part], own_groups[:, run] - marks.offsets[run]
            others = gn > 0
            others[rows_at, own] = False
            size = gn[rows_at, own]
            a = gs[rows_at, own] / np.maximum(size - 1, 1)
            b = np.where(others, gs / np.maximum(gn, 1), np.inf).min(axis=1)
            scored = (size >= 2) & others.any(axis=1)
            a, b = a[scored], b[scored]
            top = np.maximum(a, b)
            total[run] += np.divide(b - a, top, out=np.zeros(len(top)), where=top > 0).sum()
            count[run] += len(top)
        return pd.DataFrame({"run": range(len(groups)), "total": total, "scored": count})

    scored = block_sums(
        labelled, row_id, [vector, labels], prepare, kernel, marks.width, score, "run int, total double, scored double",
        keep=[labels], **sizing,
    )
    return scored.groupBy("run").agg(
        F.coalesce(F.sum("total") / F.nullif(F.sum("scored"), F.lit(0.0)), F.lit(0.0)).alias("silhouette"),
        F.sum("scored").cast("bigint").alias("scored_rows"),
    )


def cluster_sizes(labels: DataFrame, label: str) -> DataFrame:
    """Group sizes, largest first, as one text."""
    sizes = labels.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("n"), asc=False), lambda x: x.cast("string")), " | ")
        .alias("cluster_sizes")
    )


def kmeans_reference(
    df: DataFrame, row_id: str, vector: str, ks: Sequence[int] = range(2, 7), seeds: Sequence[int] = range(25)
) -> DataFrame:
    """Best silhouette over the seeds and its group sizes, for each k."""
    runs = kmeans(df, row_id, vector, ks, seeds)
    labelled = label_runs(df, row_id, vector, runs)
    return best_runs(labelled, row_id, vector, runs)


def best_runs(labelled: DataFrame, row_id: str, vector: str, runs: Sequence[Run]) -> DataFrame:
    spark = labelled.sparkSession
    scores = silhouettes(labelled, row_id, vector, "labels", [r.k for r in runs])
    info = spark.createDataFrame([(i, r.k, r.seed) for i, r in enumerate(runs)], "run int, k int, seed int")
    best = scores.join(info, "run").groupBy("k").agg(
        F.max_by(F.struct("run", "seed", "silhouette"), F.struct("silhouette", -F.col("seed"))).alias("b")
    ).select("k", "b.*")
    members = labelled.select(F.posexplode("labels").alias("run", "label")).groupBy("run", "label").agg(F.count("*").alias("n"))
    sizes = members.groupBy("run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("n"), asc=False), lambda x: x.cast("string")), " | ")
        .alias("cluster_sizes")
    )
    return best.join(sizes, "run").select("k", "seed", F.round("silhouette", 4).alias("silhouette"), "cluster_sizes")


def kmedoids(
    df: DataFrame, row_id: str, vector: str, ks: Sequence[int] = range(2, 7), seeds: Sequence[int] = range(30),
    iterations: int = 100, **sizing,
) -> list[Run]:
    """Medoids under Euclidean distance for every (k, seed) until the medoid set repeats."""
    runs = random_starts(df, row_id, vector, list(ks), list(seeds))
    types = dict(df.dtypes)
    sizing = {"rows": df.count(), **sizing}

    def prepare(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return stack(pdf[vector]), stack(pdf["labels"]).astype(int)

    for _ in range(iterations):
        live = [r for r in runs if not r.done]
        if not live:
            break
        marks = Marks([r.k for r in live])

        def kernel(left: Sequence[np.ndarray], right: Sequence[np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
            # Distances to the rows of each group in each run, of which a row's own groups are kept.
            d = distances(left[0], right[0])
            a, b = (labels + marks.offsets[:-1] for labels in (left[1], right[1]))
            first = np.take_along_axis(d @ marks.table(b), a, axis=1)
            return first, first if same else np.take_along_axis(d.T @ marks.table(a), b, axis=1)

        def cheapest(rows: pd.DataFrame, cost: np.ndarray, _: np.ndarray) -> pd.DataFrame:
            labels, rank = stack(rows["labels"]).astype(int), rows[row_id].rank(method="dense", na_option="top").to_numpy()
            found = []
            for run in range(labels.shape[1]):
                order = np.lexsort((rank, cost[:, run], labels[:, run]))
                first = order[np.flatnonzero(np.diff(labels[order, run], prepend=-1))]
                found.append(rows.iloc[first][[row_id, vector]].assign(run=run, label=labels[first, run], cost=cost[first, run]))
            return pd.concat(found, ignore_index=True)

        costs = block_sums(
            label_runs(df, row_id, vector, live), row_id, [vector, "labels"], prepare, kernel, len(live), cheapest,
            f"{row_id} {types[row_id]}, {vector} array<double>, run int, label int, cost double", **sizing,
        )
        medoids = costs.groupBy("run", "label").agg(
            F.min_by(F.struct(F.col(row_id).alias("id"), F.col(vector).alias("x")), F.struct("cost", row_id)).alias("m")
        ).collect()
        before = [set(r.ids) for r in live]
        for row in medoids:
            run = live[row["run"]]
            run.ids[row["label"]], run.centres[row["label"]] = row["m"]["id"], np.asarray(row["m"]["x"])
        for run, old in zip(live, before):
            run.done = set(run.ids) == old
    return runs


@dataclass
class Archetypes:
    """Corners of the data cloud, the rows each is mixed from, and the fit."""

    corners: np.ndarray
    atoms: list[dict]
    residual: float
    explained: float


def archetypes(
    df: DataFrame, row_id: str, vector: str, k: int, seed: int = 1, restarts: int = 8, rounds: int = 25,
    tolerance: float = 1e-7,
) -> Archetypes:
    """Archetypal analysis: every row is a convex mix of ``k`` corners, every corner a convex
    mix of rows.

    Each round reads the rows twice: once for their weights and the ``k``-sized sums they
    imply, once for the row that improves each corner most (a linear minimum, so one row
    per partition and corner is sent). Corners are then refitted on the driver over the few
    rows picked so far.
    """
    if k < 1:
        raise ValueError("the number of archetypes must lie between 1 and the number of rows")
    starts = starting_rows(df, row_id, vector, [(k, seed * restarts + r) for r in range(restarts)])
    if len(starts[0]) < k:
        raise ValueError("the number of archetypes must lie between 1 and the number of rows")
    atoms: list[list[tuple]] = []
    mixes: list[np.ndarray] = []
    for picked in starts:
        atoms.append([(i, np.asarray(x, dtype="float64")) for i, x in picked])
        mixes.append(np.eye(k))
    width = len(atoms[0][0][1])
    residuals, previous = np.full(restarts, np.inf), np.full(restarts, np.inf)
    live = list(range(restarts))
    spread = None
    best: tuple[float, np.ndarray, list[dict]] | None = None
    for _ in range(rounds):
        corners = {r: mixes[r] @ np.stack([x for _, x in atoms[r]]) for r in live}

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = {r: np.zeros(k * k + k * width + width + 2) for r in corners}
            for pdf in batches:
                z = stack(pdf[vector])
                for r, a in corners.items():
                    w = convex_weights(z, a)
                    gap = ((z - w @ a) ** 2).sum()
                    totals[r] += np.concatenate(
                        [(w.T @ w).ravel(), (w.T @ z).ravel(), z.sum(axis=0), [gap, len(z)]]
                    )
            yield pd.DataFrame({"run": list(totals), "sums": list(totals.values())})

        parts = df.select(vector).mapInPandas(sums, "run int, sums array<double>")
        table = {r: flat for (r,), flat in added(parts, ["run"]).items()}
        if spread is None:
            mean = table[live[0]][k * k + k * width : -2] / table[live[0]][-1]

            def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    yield pd.DataFrame({"s": [((stack(pdf[vector]) - mean) ** 2).sum()]})

            spread = df.select(vector).mapInPandas(scatter, "s double").agg(F.sum("s")).first()[0] or 0.0
        slopes = {}
        for r in list(live):
            inner, cross = table[r][: k * k].reshape(k, k), table[r][k * k : k * k + k * width].reshape(k, width)
            residuals[r] = table[r][-2]
            if best is None or residuals[r] < best[0]:
                used = [
                    {atoms[r][j][0]: float(mixes[r][c, j]) for j in np.flatnonzero(mixes[r][c] > 1e-9)} for c in range(k)
                ]
                best = (residuals[r], corners[r], used)
            if previous[r] - residuals[r] <= tolerance * max(previous[r], 1.0) and np.isfinite(previous[r]):
                live.remove(r)
                continue
            previous[r] = residuals[r]
            slopes[r] = (inner, cross, inner @ corners[r] - cross)
        if not live:
            break
        slope_only = {r: s[2] for r, s in slopes.items()}
        types = dict(df.dtypes)

        def steepest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: dict[tuple[int, int], tuple] = {}
            for pdf in batches:
                z = stack(pdf[vector])
                for r, g in slope_only.items():
                    values = z @ g.T
                    for c, i in enumerate(values.argmin(axis=0)):
                        if (r, c) not in found or values[i, c] < found[r, c][0]:
                            found[r, c] = (float(values[i, c]), pdf[row_id].iloc[i], z[i])
            yield pd.DataFrame(
                [(r, c, v, name, x) for (r, c), (v, name, x) in found.items()],
                columns=["run", "corner", "value", row_id, vector],
            )

        pulled = df.select(row_id, vector).mapInPandas(
            steepest, f"run int, corner int, value double, {row_id} {types[row_id]}, {vector} array<double>"
        )
        winners = pulled.groupBy("run", "corner").agg(
            F.min_by(F.struct(F.col(row_id).alias("id"), F.col(vector).alias("x")), F.struct("value", row_id)).alias("w")
        ).collect()
        for row in winners:
            known = {name for name, _ in atoms[row["run"]]}
            if row["w"]["id"] not in known:
                atoms[row["run"]].append((row["w"]["id"], np.asarray(row["w"]["x"])))
        for r in live:
            inner, cross, _ = slopes[r]
            mixes[r] = refit_corners(inner, cross, np.stack([x for _, x in atoms[r]]), mixes[r])
            used_atoms = np.flatnonzero((mixes[r] > 1e-9).any(axis=0))
            atoms[r], mixes[r] = [atoms[r][j] for j in used_atoms], mixes[r][:, used_atoms]
    residual, corners_best, used = best
    return Archetypes(corners_best, used, residual, 1 - residual / spread if spread > 0 else 1.0)


def refit_corners(inner: np.ndarray, cross: np.ndarray, points: np.ndarray, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Mixing weights of the corners over the picked rows for fixed row weights."""
    mix = np.zeros((len(inner), len(points)))
    mix[:, : start.shape[1]] = start
    gram, pull = points @ points.T, cross @ points.T
    lipschitz = max(float(np.linalg.eigvalsh(inner)[-1] * np.linalg.eigvalsh(gram)[-1]), 1e-12)
    for _ in range(steps):
        mix = project_rows(mix - (inner @ mix @ gram - pull) / lipschitz)
    return mix


def mixtures(df: DataFrame, row_id: str, vector: str, fit: Archetypes, pure: float = 0.6) -> DataFrame:
    """Weights ``w_A0..``, the dominant archetype, its weight and whether the row is mixed."""
    corners, k = fit.corners, len(fit.corners)
    types = dict(df.dtypes)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({row_id: pdf[row_id], "w": list(convex_weights(stack(pdf[vector]), corners, 2000))})

    weighed = df.select(row_id, vector).mapInPandas(weigh, f"{row_id} {types[row_id]}, w array<double>")
    return mixture_table(weighed.select(row_id, *[F.col("w")[i].alias(f"w_A{i}") for i in range(k)]), row_id, k, pure)


def mixture_table(weights: DataFrame, row_id: str, k: int, pure: float = 0.6) -> DataFrame:
    columns = [F.col(f"w_A{i}") for i in range(k)]
    top = F.greatest(*columns) if k > 1 else columns[0]
    leader = F.concat(F.lit("A"), (F.array_position(F.array(*columns), top) - 1).cast("string"))
    return weights.select(
        row_id, *[F.round(c, 4).alias(f"w_A{i}") for i, c in enumerate(columns)],
        leader.alias("dominant"), F.round(top, 4).alias("max_weight"), (top <= pure).alias("is_mixed"),
    )


def purest(mixed: DataFrame, row_id: str, k: int, top: int = 6) -> DataFrame:
    """The rows with the largest weight on each archetype, best first."""
    from pyspark.sql import Window

    long = mixed.unpivot([row_id], [f"w_A{i}" for i in range(k)], "archetype", "weight")
    rank = Window.partitionBy("archetype").orderBy(F.col("weight").desc(), row_id)
    return long.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
