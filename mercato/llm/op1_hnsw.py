"""Embedding near-dedup with hierarchical navigable small-world graphs (HNSW).

Equal vectors of one label form a class and are indexed once.  The classes of a
label are dealt into shards of bounded size; each shard gets a graph, built in
one task and stored.  Blocks of query classes are then sent to every shard of
their label.  The beam of a (block, shard) task widens, for the queries with links and for
those without apart, until an audit against brute force finds every link of the
audited queries and their nearest neighbours; the audit looks at random queries and
at those whose finds are the worst.  Hits are verified in double precision.  A task returns, per class, the number of linked vectors and one
edge to the local union's root, never all pairs of a group.

Defined results: a null, zero, ragged or non-finite vector, or a null label,
links with nothing (its own id is its component); rows with the same vec_id
count as separate vectors; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import components, mix64, stored

M = 16
#: Neighbours this far below the threshold stand for links in an audit that sees none.
NEAR = 0.1


def _search(vec, adj, entry, q, ef):
    """Beam search of all queries in lockstep over one layer: (ids, sims), each row best first."""
    n, rows = len(vec), np.arange(len(q))
    ids = np.full((len(q), ef), -1, np.int64)
    sims = np.full((len(q), ef), -2.0, np.float32)
    done = np.ones((len(q), ef), bool)
    ids[:, 0], done[:, 0] = entry, False
    sims[:, 0] = np.einsum("ij,ij->i", vec[entry], q)
    seen = np.zeros((len(q), n + 1), bool)
    seen[rows, entry] = True
    while True:
        best = np.where(done, -3.0, sims)
        at = best.argmax(1)
        act = rows[best[rows, at] > -2.5]
        if not len(act):
            return ids, sims
        done[act, at[act]] = True
        near = adj[ids[act, at[act]]]
        new = near.copy()
        new[seen[act[:, None], near]] = -1
        seen[act[:, None], near] = True
        seen[:, n] = False
        s = np.einsum("ijk,ik->ij", vec[new], q[act])
        s[new < 0] = -2.0
        all_ids = np.concatenate([ids[act], new], 1)
        all_sims = np.concatenate([sims[act], s], 1)
        all_done = np.concatenate([done[act], new < 0], 1)
        top = np.argsort(-all_sims, 1, kind="stable")[:, :ef]
        ids[act] = np.take_along_axis(all_ids, top, 1)
        sims[act] = np.take_along_axis(all_sims, top, 1)
        done[act] = np.take_along_axis(all_done, top, 1) | (ids[act] < 0)


def _select(vec, q, ids, sims, m):
    """Up to m neighbours per row: first those nearer to the query than to any
    chosen before, best first, then the best of the rest."""
    rows = np.arange(len(ids))
    open_, chosen = ids >= 0, np.zeros(ids.shape, bool)
    for _ in range(m):
        at = np.where(open_, sims, -3.0).argmax(1)
        ok = open_[rows, at]
        if not ok.any():
            break
        chosen[rows[ok], at[ok]] = True
        open_[rows, at] = False
        open_ &= ~((np.einsum("ijk,ik->ij", vec[ids], vec[ids[rows, at]]) > sims) & ok[:, None])
    top = np.argsort(-(np.where(ids >= 0, sims, -9.0) + 4.0 * chosen), 1, kind="stable")[:, :m]
    out = np.full((len(ids), m), -1, np.int64)
    out[:, :top.shape[1]] = np.take_along_axis(ids, top, 1)
    return out


def build(vec: np.ndarray, ef: int = 48) -> list[np.ndarray]:
    """Adjacency of every layer, top first; vec has unit rows.  Rows come in an
    order that has the nodes of higher layers first, so that a layer is a prefix.
    Nodes are inserted in growing batches that search the graph so far."""
    n = len(vec)
    sizes = [n]
    while sizes[-1] > M:
        sizes.append(max(1, sizes[-1] // M))
    layers: list[np.ndarray] = []
    for size in reversed(sizes):
        deg = 2 * M
        adj = np.full((n, deg), -1, np.int64)
        at = 1
        while at < size:
            to = min(size, at + max(1, min(at // 4, 512)))
            q = vec[at:to]
            entry = descend(vec, layers, q)
            entry = np.where(entry < at, entry, 0)
            ids, sims = _search(vec, adj, entry, q, ef)
            adj[at:to, :M] = _select(vec, q, ids, sims, M)
            src = np.repeat(np.arange(at, to), M)
            dst = adj[at:to, :M].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
            cand = np.full((len(nodes), deg + count.max(initial=0)), -1, np.int64)
            cand[:, :deg] = adj[nodes]
            cand[np.repeat(np.arange(len(nodes)), count), deg + np.arange(len(dst)) - np.repeat(first, count)] = src
            full = (cand >= 0).sum(1) > deg
            pack = np.take_along_axis(cand, np.argsort(cand < 0, 1, kind="stable"), 1)
            adj[nodes[~full]] = pack[~full][:, :deg]
            if full.any():
                c = cand[full]
                s = np.where(c >= 0, np.einsum("ijk,ik->ij", vec[c], vec[nodes[full]]), -2.0)
                adj[nodes[full]] = _select(vec, vec[nodes[full]], c, s, deg)
            at = to
        layers.append(adj)
    return layers


def descend(vec, layers, q):
    """The nearest node greedily found from the top layer down, per query."""
    entry = np.zeros(len(q), np.int64)
    for adj in layers:
        entry = _search(vec, adj, entry, q, 1)[0][:, 0]
    return entry


def _links(vec, exact, layers, q, q_exact, same, thr, ef):
    """(links, best): linked (query, node) positions, verified in double precision (the hits of
    a beam search, then all hits that the graph reaches from hits), and the best
    similarity that the beam saw for each query; ``same`` is a query's own node and counts as neither."""
    ids, sims = _search(vec, layers[-1], descend(vec, layers[:-1], q), q, min(ef, len(vec)))
    best = np.where((ids >= 0) & (ids != same[:, None]), sims, -2.0).max(1)
    r, c = np.nonzero(sims >= thr - 1e-3)
    front = np.stack([r, ids[r, c]])
    seen = np.zeros((len(q), len(vec)), bool)
    seen[front[0], front[1]] = True
    found = [front]
    while front.shape[1]:
        nxt = []
        for i in range(0, front.shape[1], 8192):
            r, c = front[:, i:i + 8192]
            near = layers[-1][c]
            r, near = np.repeat(r, near.shape[1])[near.ravel() >= 0], near[near >= 0]
            new = ~seen[r, near]
            r, near = np.unique(np.stack([r[new], near[new]]), axis=1) if new.any() else (r[new], near[new])
            seen[r, near] = True
            ok = np.einsum("ij,ij->i", q[r], vec[near]) >= thr - 1e-3
            nxt.append(np.stack([r[ok], near[ok]]))
        front = np.concatenate(nxt, 1)
        found.append(front)
    f = np.concatenate(found, 1)
    ok = np.concatenate([np.einsum("ij,ij->i", q_exact[f[0, i:i + 65536]], exact[f[1, i:i + 65536]])
                         for i in range(0, f.shape[1], 65536)] or [np.zeros(0)]) >= thr
    ok &= same[f[0]] != f[1]
    return f[:, ok], best


def _scan(exact, q_exact, same, thr):
    """(links, best) by brute force in double precision."""
    hits, best = [], []
    for i in range(0, len(q_exact), 512):
        s = q_exact[i:i + 512] @ exact.T
        own = np.flatnonzero(same[i:i + 512] >= 0)
        s[own, same[i + own]] = -2.0
        hits.append(np.stack(np.nonzero(s >= thr)) + [[i], [0]])
        best.append(s.max(1))
    return np.concatenate([np.zeros((2, 0), np.int64), *hits], 1), np.concatenate([np.zeros(0), *best])


def probe(vec, layers, q, thr, audit, ef=64, same=None):
    """(links, beam, recall): all queries against one shard, the widest beam used, and the share of the
    audited links that the beam had found (nan if the audited queries have none).

    After a search the queries fall into those with a link and those without.  Of each kind up to
    ``audit`` queries are scanned by brute force: random ones, and of those without a link
    as many again whose best find is the worst, for a search that went astray ends
    among strangers.  A kind passes if its audited queries missed no link and, of those without links whose
    nearest neighbour is almost one (within NEAR), at most one in twenty missed it; else all its queries are searched again with twice the beam.  A beam whose
    neighbours would be as many as the shard's vectors is an exact scan instead."""
    exact, q_exact = vec, q
    vec, q = vec.astype(np.float32), q.astype(np.float32)
    same = np.full(len(q), -1) if same is None else same
    order = np.argsort(mix64(np.arange(len(q), dtype=np.uint64)))
    todo, kept, had, true = np.arange(len(q)), [], 0, 0
    while len(todo):
        if ef * 2 * M >= len(vec):
            f, _ = _scan(exact, q_exact[todo], same[todo], thr)
            kept.append(np.stack([todo[f[0]], f[1]]))
            ef, had, true = len(vec), f.shape[1], f.shape[1]
            break
        f, best = _links(vec, exact, layers, q[todo], q_exact[todo], same[todo], thr, ef)
        n = np.bincount(f[0], minlength=len(todo))
        again = np.zeros(len(todo), bool)
        shuffled = np.argsort(np.argsort(order)[todo])
        had = true = 0
        for linked in (False, True):
            kind = np.flatnonzero((n > 0) == linked)
            sample = kind[np.argsort(shuffled[kind])][:audit]
            if not linked:
                sample = np.union1d(sample, kind[np.argsort(best[kind], kind="stable")][:audit])
            want, nearest = _scan(exact, q_exact[todo[sample]], same[todo[sample]], thr)
            had, true = had + int(n[sample].sum()), true + want.shape[1]
            almost = nearest >= thr - NEAR if not linked else np.zeros(len(sample), bool)
            astray = (almost & (nearest > best[sample] + 1e-4)).sum()
            again[kind] = want.shape[1] > n[sample].sum() or astray > almost.sum() / 20
        done = ~again[f[0]]
        kept.append(np.stack([todo[f[0, done]], f[1, done]]))
        todo = todo[again]
        if len(todo):
            ef *= 2
    return np.concatenate([np.zeros((2, 0), np.int64), *kept], 1), ef, had / true if true else float("nan")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected position of each of n positions, by repeated minima."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = 8192,
                 block_rows: int = 4096, audit: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("label"))
    good = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull()
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("v", lambda x: x != 0))
    base = base.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    classes = base.where("v is not null").groupBy("label", "v").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    classes = stored(classes.withColumn("part", F.concat_ws("/", "label", F.size("v"))), "vectors")
    sizes = classes.groupBy("part").agg(F.count("*").alias("n"))
    dealt = classes.join(sizes, "part").select(
        "part", "rep", "mult", "v",
        F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / shard_rows)).alias("shard"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("n") / block_rows)).alias("block"))

    def unit(v: pd.Series) -> np.ndarray:
        x = np.stack(v.to_numpy()).astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort(mix64(pdf.rep.to_numpy().astype(np.uint64)), kind="stable")]
        x = unit(pdf.v)
        layers = np.stack(build(x.astype(np.float32))).astype(np.int32)
        return pd.DataFrame([(pdf.part.iloc[0], pdf.shard.iloc[0], pdf.rep.to_numpy().astype(np.int64).tobytes(),
                              pdf.mult.to_numpy().astype(np.int64).tobytes(), x.tobytes(), layers.tobytes(), len(layers))])

    graphs = stored(dealt.groupBy("part", "shard").applyInPandas(
        index, "part string, shard long, rep binary, mult binary, vec binary, adj binary, n_layers int"), "graphs")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        return pd.DataFrame([(pdf.part.iloc[0], pdf.block.iloc[0], pdf.rep.to_numpy().astype(np.int64).tobytes(),
                              unit(pdf.v).tobytes())])

    blocks = dealt.groupBy("part", "block").applyInPandas(pack, "part string, block long, q_rep binary, q binary")

    def search(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                rep, mult, q_rep = (np.frombuffer(x, np.int64) for x in (r.rep, r.mult, r.q_rep))
                vec = np.frombuffer(r.vec).reshape(len(rep), -1)
                q = np.frombuffer(r.q).reshape(len(q_rep), -1)
                layers = list(np.frombuffer(r.adj, np.int32).reshape(r.n_layers, len(rep), -1).astype(np.int64))
                at = {r: i for i, r in enumerate(rep.tolist())}
                own = np.array([at.get(r, -1) for r in q_rep.tolist()])
                hit, beam, recall = probe(vec, layers, q, threshold, audit, same=own)
                n = np.bincount(hit[0], mult[hit[1]], len(q)).astype(np.int64)
                ids, pos = np.unique(np.concatenate([q_rep, rep]), return_inverse=True)
                root = ids[_roots(len(ids), pos[:len(q)][hit[0]], pos[len(q):][hit[1]])]
                links = np.zeros(len(ids), np.int64)
                links[pos[:len(q)]] = n
                keep = (links > 0) | (root != ids)
                yield pd.DataFrame({"node": ids[keep], "links": links[keep], "root": root[keep], "beam": beam, "recall": recall})  # recall: of the audited links

    # one (block, shard) pair to a task at a time: a row holds two bounded blobs
    pairs = blocks.join(graphs, "part").repartition(F.xxhash64("part", "block", "shard"))
    found = stored(pairs.mapInPandas(search, "node long, links long, root long, beam long, recall double"), "found")
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    # copies of one vector are linked with each other and share their class's component
    whole = classes.join(linked, classes.rep == linked.node, "left").drop("node").join(
        comps, classes.rep == comps.node, "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    return base.join(whole, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("c", "vec_id")).alias("kept"))
