"""The k most similar vectors of every vector (problem 2): a navigable small-world graph per shard, results merged.

1. Vectors are checked, brought to length 1 and kept once per distinct vector; copies come back at the end.
2. *Shards.*  Two levels of spherical k-means cut the space into cells of about ``shard`` vectors: the driver fits
   the square root of the number of cells on a bounded sample, and one task per coarse cell fits its share of the
   fine ones on the sample rows that fall there.  The sample is the rows whose hash is below a bound, SAMPLE rows
   per cell but SAMPLE_MOST in all.  At most CELLS fine centroids exist (64 MB at 64 numbers), which is all that is ever broadcast; beyond
   ``shard`` x CELLS vectors the shards grow, which a graph search feels only by the logarithm.  Every vector is
   indexed in the cell of its nearest centroid; a cell with more than ``max_shard`` vectors is dealt out to several
   shards, which all its visitors search.
3. *Graph.*  Each shard builds a hierarchical navigable small-world graph as flat neighbour arrays.  Insertion and
   search run in lock step over batches: all queries of a batch take their next hop together in NumPy, batches
   growing with the graph (never more than BATCH at a time).  Neighbours are chosen by the usual diversity rule, reverse
   links are pruned by the same rule.
4. Each vector searches the shards of its own cell and visits further cells whose centroid is nearly as near
   (``margin``, at most ``probes``).  What a search finds counts for both ends: a visitor becomes a candidate of the
   vectors it meets, so a pair is found if either of the two comes to the other.  The k best over all shards are kept.

``exact`` sends every vector to every cell and compares by matrix products: the reference for measuring recall, of
quadratic cost.  Accuracy on the test data is in the README (over 0.99).

Defined cases: vectors that are null, of another length, not finite or all zero take no part, nor do null keys;
repeated rows of a key count once (the least vector, should they differ); equal vectors are neighbours of
similarity 1; ties go to the lesser key; fewer than k other vectors give fewer neighbours; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut_lineage

#: Vectors of a shard, rows of the sample per cell, most cells, vectors beyond which a cell is dealt out.
SHARD, SAMPLE, CELLS, MAX_SHARD = 3000, 48, 1 << 18, 1 << 16
SAMPLE_MOST = 1 << 22
PROBES, MARGIN, COARSE = 6, 0.06, 8
LINKS, EF_BUILD, EF_SEARCH, EF_GUEST, EF_UPPER, BATCH, WIDE = 14, 24, 16, 12, 4, 1024, 4
#: A batch of insertions is at most this part of the graph, since its nodes do not see each other.
GROWTH = 0.3
#: Bits of the table of nodes that a batch has seen.
SEEN = 1 << 24


# ---------------------------------------------------------------------------------------------- graph


class SmallWorld:
    """Hierarchical navigable small-world graph over the rows of ``x`` (unit vectors)."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: int = LINKS, ef_build: int = EF_BUILD) -> None:
        self.x, self.links, self.ef_build = x, links, ef_build
        order = np.argsort(-levels, kind="stable")  # nodes of high levels first: they carry the search for the others
        self.levels = levels
        n = len(x)
        self.batch = max(32, min(BATCH, SEEN // max(1, n)))
        self.top = int(levels.max()) if n else 0
        self.graph = [np.full((n, links * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(self.top + 1)]
        self.entry = order[:1].astype(np.int32)
        at = 1
        while at < n:
            size = min(max(1, int(GROWTH * at)), self.batch, n - at)
            self._insert(order[at : at + size])
            at += size

    def search(self, q: np.ndarray, level: int, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the ``ef`` best nodes found on a level from the given nodes, best first; -1 fills."""
        x, graph = self.x, self.graph[level]
        b, width = len(q), graph.shape[1]
        n = len(x)
        ids = np.full((b, ef), -1, np.int32)
        sims = np.full((b, ef), -2.0, np.float32)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # where -1 points
        m = min(start.shape[1], ef)
        ids[:, :m] = start[:, :m]
        ok = ids[:, :m] >= 0
        sims[:, :m] = np.where(ok, np.einsum("bmd,bd->bm", x[ids[:, :m]], q), -2.0)
        np.put_along_axis(seen, np.where(ok, ids[:, :m], n), True, 1)
        done = ids < 0
        live = np.arange(b)
        flat, mark = seen.reshape(-1), np.empty(seen.size, np.int16)
        while len(live):
            li, ls, ld = ids[live], sims[live], done[live]
            pick = np.argpartition(np.where(ld, 3.0, -ls), min(WIDE, ef) - 1, axis=1)[:, :WIDE] if ef > WIDE else np.argsort(np.where(ld, 3.0, -ls), axis=1)[:, :1]
            ready = ~np.take_along_axis(ld, pick, 1)
            keep = ready.any(1)
            if not keep.all():
                live, li, ls, ld, pick, ready = live[keep], li[keep], ls[keep], ld[keep], pick[keep], ready[keep]
                if not len(live):
                    break
            nodes = np.where(ready, np.take_along_axis(li, pick, 1), -1)
            np.put_along_axis(ld, pick, True, 1)
            new = graph[nodes].reshape(len(live), -1)
            if not ready.all():
                new = np.where(np.repeat(ready, width, axis=1), new, -1)
            new = np.where(new < 0, n, new)
            spot = live[:, None] * (n + 1) + new
            rows, cols = np.nonzero(~flat.take(spot))
            at = spot[rows, cols]
            mark[at] = cols  # two picked nodes may share a neighbour: the last mention stays
            once = mark[at] == cols
            rows, cols, at = rows[once], cols[once], at[once]
            flat[at] = True
            cand = new[rows, cols]
            fresh = np.zeros(new.shape, bool)
            fresh[rows, cols] = True
            ns = np.full(new.shape, -2.0, np.float32)
            ns[rows, cols] = np.einsum("nd,nd->n", x[cand], q[live[rows]])
            alls = np.concatenate((ls, ns), 1)
            alli = np.concatenate((li, np.where(fresh, new, -1).astype(np.int32)), 1)
            alld = np.concatenate((ld, ~fresh), 1)
            best = np.argpartition(-alls, ef - 1, axis=1)[:, :ef]
            ids[live] = np.take_along_axis(alli, best, 1)
            sims[live] = np.take_along_axis(alls, best, 1)
            done[live] = np.take_along_axis(alld, best, 1)
        o = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)

    def choose(self, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """The ``m`` neighbours kept of candidates sorted by similarity: diverse ones first, then the nearest rest."""
        b, c = ids.shape
        v = self.x[ids]
        between = np.matmul(v, v.transpose(0, 2, 1))
        valid = ids >= 0
        chosen = np.zeros((b, c), bool)
        nearest = np.full((b, c), -2.0, np.float32)  # greatest similarity to a chosen one
        count = np.zeros(b, np.int64)
        for j in range(c):
            take = valid[:, j] & (sims[:, j] > nearest[:, j]) & (count < m)
            chosen[:, j] = take
            count += take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * (c + 1) + np.arange(c)
        o = np.argsort(rank, axis=1, kind="stable")[:, :m]
        return np.where(np.take_along_axis(valid, o, 1), np.take_along_axis(ids, o, 1), -1)

    def _insert(self, nodes: np.ndarray) -> None:
        q = self.x[nodes]
        start = np.repeat(self.entry[None, :], len(nodes), 0)
        for lv in range(self.top, -1, -1):
            here = self.levels[nodes] >= lv
            ids, sims = self.search(q, lv, start, self.ef_build if here.any() else EF_UPPER)
            if here.any():
                mine = nodes[here]
                kept = self.choose(ids[here], sims[here], self.links)  # the rest of the width is for links back
                self.graph[lv][mine, : kept.shape[1]] = kept
                self._link_back(lv, mine, kept)
            start = ids[:, :EF_UPPER]

    def _link_back(self, lv: int, mine: np.ndarray, kept: np.ndarray) -> None:
        graph = self.graph[lv]
        m = graph.shape[1]
        to = kept.ravel()
        frm = np.repeat(mine, kept.shape[1])
        ok = to >= 0
        to, frm = to[ok], frm[ok]
        if not len(to):
            return
        near = np.einsum("nd,nd->n", self.x[to], self.x[frm])
        o = np.lexsort((-near, to))
        to, frm = to[o], frm[o]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        ok = place < m
        targets = to[first]
        extra = np.full((len(targets), m), -1, np.int32)
        row = np.repeat(np.arange(len(targets)), np.diff(np.append(first, len(to))))
        extra[row[ok], place[ok]] = frm[ok]
        have, more = (graph[targets] >= 0).sum(1), (extra >= 0).sum(1)
        roomy = have + more <= m  # these need no pruning
        if roomy.any():
            r = np.flatnonzero(roomy)
            rr = np.repeat(r, more[r])
            cc = np.arange(len(rr)) - np.repeat(np.cumsum(more[r]) - more[r], more[r])
            graph[targets[rr], have[rr] + cc] = extra[rr, cc]
        if roomy.all():
            return
        targets, extra = targets[~roomy], extra[~roomy]
        ids = np.concatenate((graph[targets], extra), 1)
        sims = np.where(ids >= 0, np.matmul(self.x[ids], self.x[targets][:, :, None])[:, :, 0], -2.0).astype(np.float32)
        o = np.argsort(-sims, axis=1, kind="stable")
        graph[targets] = self.choose(np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1), m)

    def neighbours(self, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """As ``query`` for the nodes themselves: their searches start from their own links."""
        out = []
        for at in range(0, len(self.x), self.batch):
            own = np.arange(at, min(at + self.batch, len(self.x)))
            out.append(self.search(self.x[own], 0, np.concatenate((own[:, None].astype(np.int32), self.graph[0][own]), 1), ef))
        return np.concatenate([i for i, _ in out]), np.concatenate([s for _, s in out])

    def query(self, q: np.ndarray, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first."""
        out_i, out_s = [], []
        for at in range(0, len(q), self.batch):
            part = q[at : at + self.batch]
            start = np.repeat(self.entry[None, :], len(part), 0)
            for lv in range(self.top, 0, -1):
                start = self.search(part, lv, start, EF_UPPER)[0]
            i, s = self.search(part, 0, start, ef)
            out_i.append(i)
            out_s.append(s)
        return np.concatenate(out_i), np.concatenate(out_s)


def levels_of(keys: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Geometric levels from hashes of the keys, so that every run draws the same ones."""
    h = np.array([xxhash.xxh64_intdigest(str(x)) for x in keys], np.uint64)
    u = (h >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(links)).astype(np.int64), 6)


def centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, seeded by farthest-first picks among random ones."""
    rng = np.random.default_rng(7)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(sample), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c.astype(np.float32)


# ---------------------------------------------------------------------------------------------- Spark


def _unit(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(k, v BINARY): usable vectors of length 1, one per key."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(size == dim)
            taken = lists.take(pa.array(own))
            flat = taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                top = np.abs(flat).max(axis=1) if len(flat) else np.zeros(0)
                ok = np.isfinite(flat).all(axis=1) & (top > 0)
                x = flat[ok] / top[ok, None]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            raw = x.astype(np.float32)
            keys = batch.column(0).take(pa.array(own[ok]))
            yield pa.RecordBatch.from_arrays([keys, pa.array([r.tobytes() for r in raw], pa.binary())], names=["k", "v"])

    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == dim)).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"k {kind}, v binary").groupBy("k").agg(F.min("v").alias("v"))


def _matrix(raw, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)


class Cells:
    """Two levels of centroids: ``coarse``, and ``fine`` whose rows of coarse cell i are first[i] to first[i + 1]."""

    def __init__(self, coarse: np.ndarray, owner: np.ndarray, fine: np.ndarray) -> None:
        order = np.argsort(owner, kind="stable")
        self.coarse, self.fine = coarse, fine[order]
        self.first = np.searchsorted(owner[order], np.arange(len(coarse) + 1))

    def near(self, x: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, fine cell, place from 0): the nearest cells of every row within the margin of the nearest one, at most ``probes``.

        Fine cells are looked for in the COARSE nearest coarse ones, in all of them if all cells are asked for.
        """
        c = _top(x @ self.coarse.T, len(self.coarse) if probes >= len(self.fine) else min(COARSE, len(self.coarse)))
        rows, cells, sims = [], [], []
        flat = c.ravel()
        order = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[order], np.arange(len(self.coarse) + 1))
        for i in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = int(self.first[i]), int(self.first[i + 1])
            if a == b:
                continue
            own = order[bounds[i] : bounds[i + 1]] // c.shape[1]
            s = x[own] @ self.fine[a:b].T
            best = _top(s, min(probes, b - a))
            rows.append(np.repeat(own, best.shape[1]))
            cells.append((best + a).ravel())
            sims.append(np.take_along_axis(s, best, 1).ravel())
        row, cell, sim = np.concatenate(rows), np.concatenate(cells), np.concatenate(sims)
        order = np.lexsort((cell, -sim, row))
        row, cell, sim = row[order], cell[order], sim[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        size = np.diff(np.append(first, len(row)))
        place = np.arange(len(row)) - np.repeat(first, size)
        ok = (place < probes) & (np.repeat(sim[first], size) - sim <= margin)
        return row[ok], cell[ok], place[ok]


def fit_cells(reps: DataFrame, n: int, dim: int, shard: int, sample: int, most: int) -> Cells:
    """Centroids of about n / ``shard`` cells, ``most`` at most, from a sample of ``sample`` rows per cell."""
    cells = max(1, min(math.ceil(n / shard), most))
    n_coarse = math.ceil(math.sqrt(cells))
    h = F.pmod(F.xxhash64("k"), F.lit(1 << 40))
    part = lambda m: reps if m >= n else reps.where(h < int((1 << 40) * m / n))
    # two samples of a bounded number of rows: the driver sees the one for the coarse centroids
    seen = _matrix(part(max(1024, sample * n_coarse)).select("k", "v").toPandas().sort_values("k")["v"], dim)
    if not len(seen):
        seen = _matrix(reps.limit(1).toPandas()["v"], dim)
    coarse = centroids(seen, min(n_coarse, len(seen)))
    shared = reps.sparkSession.sparkContext.broadcast(coarse)
    rows = max(1024, min(sample * cells, SAMPLE_MOST))
    share = rows / cells

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"c": (_matrix(pdf["v"], dim) @ shared.value.T).argmax(1).astype(np.int32), "k": pdf["k"], "v": pdf["v"]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf.sort_values("k")["v"], dim)
        fine = centroids(x, min(len(x), max(1, round(len(x) / share))))
        return pd.DataFrame({"c": np.int32(pdf["c"].iloc[0]), "v": [r.tobytes() for r in fine]})

    kind = reps.schema["k"].dataType.simpleString()
    fitted = part(rows).select("k", "v").mapInPandas(assign, f"c int, k {kind}, v binary").groupBy("c").applyInPandas(fit, "c int, v binary").toPandas()
    if not len(fitted):
        return Cells(coarse, np.arange(len(coarse)), coarse)
    fitted = fitted.sort_values(["c", "v"])
    return Cells(coarse, fitted["c"].to_numpy(), _matrix(fitted["v"], dim))


def _best(who: np.ndarray, whom: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of every ``who``, each pair counted for both ends and once."""
    a, b, s = np.concatenate((who, whom)), np.concatenate((whom, who)), np.concatenate((s, s))
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    if not len(a):
        return a, b, s
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    a, b, s = a[new], b[new], s[new]
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    keep = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < k
    return a[keep], b[keep], s[keep]


def nearest(
    df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, *, shard: int = SHARD, sample: int = SAMPLE, cells: int = CELLS, max_shard: int = MAX_SHARD,
    probes: int = PROBES, margin: float = MARGIN, ef: int = EF_SEARCH, ef_guest: int = EF_GUEST, exact: bool = False,
) -> DataFrame:
    """(key, neighbour, similarity DOUBLE, rank INT): the ``k`` most similar of every usable vector; see the module for the parameters."""
    kind = df.schema[key].dataType.simpleString()
    spark = df.sparkSession
    every = cut_lineage(_unit(df, key, vector, dim))
    # copies: one key stands for all keys of a vector, told apart by a 128-bit hash that is small enough to shuffle
    hashed = every.select("k", F.md5("v").alias("h"))
    groups = hashed.groupBy("h").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n"))
    shared_vectors = cut_lineage(hashed.join(groups.where("n > 1").select("h", "rep"), "h").select("k", "rep"))
    copies = not shared_vectors.isEmpty()
    reps = every.join(shared_vectors.where("k <> rep").select("k"), "k", "left_anti") if copies else every
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], f"{key} {kind}, neighbour {kind}, similarity double, rank int")
    fitted = fit_cells(reps, n, dim, shard, sample, cells)
    shared = spark.sparkContext.broadcast(fitted)  # at most CELLS rows
    n_cells = len(fitted.fine)
    most = n_cells if exact else probes
    reach = 4.0 if exact else margin

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_cells, np.int64)
        for pdf in batches:
            if len(pdf):
                total += np.bincount(shared.value.near(_matrix(pdf["v"], dim), 1, 0.0)[1], minlength=n_cells)
        yield pd.DataFrame({"cell": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    # one number per cell; cells with too many vectors are dealt out to several shards and are searched in all of them
    parts = np.ones(n_cells, np.int64)
    for r in reps.select("v").mapInPandas(load, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        parts[r["cell"]] = math.ceil(r["n"] / max_shard)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rows, cs, place = shared.value.near(_matrix(pdf["v"], dim), most, reach)
            again = parts[cs]
            first = np.cumsum(again) - again
            part = np.arange(again.sum()) - np.repeat(first, again)
            rows, place, cs = np.repeat(rows, again), np.repeat(place, again), np.repeat(cs, again)
            own = (pdf["b"].to_numpy()[rows] % parts[cs]) == part
            yield pd.DataFrame({"cell": cs.astype(np.int32), "part": part.astype(np.int32), "home": (place == 0) & own, "k": pdf["k"].to_numpy()[rows], "v": pdf["v"].to_numpy()[rows]})

    hashes = F.pmod(F.xxhash64("k"), F.lit(1 << 30)).cast("bigint").alias("b")
    routed = reps.select("k", "v", hashes).mapInPandas(route, f"cell int, part int, home boolean, k {kind}, v binary")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy()
        keys = pdf["k"].to_numpy()
        index, other = np.flatnonzero(home), np.flatnonzero(~home)
        if not len(index):
            return pd.DataFrame({"k": [], "nk": [], "s": []})
        index, other = index[np.argsort(keys[index], kind="stable")], other[np.argsort(keys[other], kind="stable")]
        x, visitors = _matrix(pdf["v"].to_numpy()[index], dim), _matrix(pdf["v"].to_numpy()[other], dim)
        if exact:
            found = _all(x, x, k + 1), _all(x, visitors, k)
        else:
            world = SmallWorld(x, levels_of(keys[index]))
            found = world.neighbours(max(ef, 2 * k)), world.query(visitors, max(ef_guest, 2 * k)) if len(other) else (np.zeros((0, 1), np.int32), np.zeros((0, 1), np.float32))
        who = np.concatenate([np.repeat(np.arange(len(hit)) + at, hit.shape[1]) for at, (hit, _) in zip((0, len(index)), found)])
        whom, s = np.concatenate([hit.ravel() for hit, _ in found]), np.concatenate([s.ravel() for _, s in found])
        ok = (whom >= 0) & (whom != who)
        who, whom, s = _best(who[ok], whom[ok].astype(np.int64), s[ok], k)
        names = np.concatenate((keys[index], keys[other]))
        return pd.DataFrame({"k": names[who], "nk": names[whom], "s": s.astype(np.float64)})

    found = routed.groupBy("cell", "part").applyInPandas(search, f"k {kind}, nk {kind}, s double")
    # a pair may be met in several shards; one exchange serves the grouping and the window
    found = found.where("k <> nk").repartition("k").groupBy("k", "nk").agg(F.max("s").alias("s"))
    w = Window.partitionBy("k").orderBy(F.desc("s"), "nk")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not copies:
        return found.select(F.col("k").alias(key), F.col("nk").alias("neighbour"), F.col("s").alias("similarity"), "rank")
    return _with_copies(found, shared_vectors, key, k)


def _all(x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the k best rows of ``x`` by comparing with all."""
    out = [(i, np.take_along_axis(s, i, 1)) for at in range(0, len(q), 2048) for s in (q[at : at + 2048] @ x.T,) for i in (_top(s, min(k, len(x))),)]
    if not out:
        return np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32)
    return np.concatenate([i for i, _ in out]), np.concatenate([s for _, s in out])


def _top(s: np.ndarray, m: int) -> np.ndarray:
    """Columns of the ``m`` greatest values of each row, greatest first."""
    if m >= s.shape[1]:
        return np.argsort(-s, axis=1, kind="stable")
    near = np.argpartition(-s, m - 1, axis=1)[:, :m]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)


def _with_copies(found: DataFrame, members: DataFrame, key: str, k: int) -> DataFrame:
    """Neighbours of all keys from those of the keys that stand for a vector; ``members`` (k, rep) of shared vectors.

    Of a vector's keys the k + 1 least are enough for anybody's neighbours.
    """
    w = Window.partitionBy("rep").orderBy("k")
    least = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    first = least.groupBy("rep").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    far = found.join(first.withColumnRenamed("rep", "nk"), "nk", "left")
    far = far.select("k", F.explode(F.coalesce("ks", F.array("nk"))).alias("neighbour"), "s")
    every = far.unionByName(first.select(F.col("rep").alias("k"), F.explode("ks").alias("neighbour"), F.lit(1.0).alias("s")))
    # an inner join for the vectors with copies, so that one with very many can be split
    theirs = every.join(members.select(F.col("rep").alias("k"), F.col("k").alias("mk")), "k").select(F.col("mk").alias(key), "neighbour", "s")
    every = every.join(first.select(F.col("rep").alias("k")), "k", "left_anti").select(F.col("k").alias(key), "neighbour", "s").unionByName(theirs)
    w = Window.partitionBy(key).orderBy(F.desc("s"), "neighbour")
    ranked = every.where(F.col(key) != F.col("neighbour")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select(key, "neighbour", F.col("s").alias("similarity"), "rank")
