"""Every registered query of the media library against its twin in SQL."""

import numpy as np
import pytest
import xxhash
from compare import plain

from prismlake.operators import online_clusters, people
from prismlake.plans import queries
from prismlake.sources.tables import Library

#: Held against plain versions below.
WITHOUT_SQL = {"content_hash", "online_clusters"}


def test_all_others_have_sql():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(name, spark, duck, sf_dir):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain([tuple(r[c] for c in columns) for r in got.collect()]) == plain(want.fetchall())


def test_content_hash(spark, duck, sf_dir):
    got = {r["doc_id"]: r["file_hash"] for r in queries.QUERIES["content_hash"](spark, sf_dir).collect()}

    def plain_hash(text):
        b = text.encode()
        if len(b) > 1 << 20:
            b = b[: 512 << 10] + b[len(b) // 2 :][: 64 << 10] + b[-(64 << 10) :] + len(b).to_bytes(8, "little")
        return xxhash.xxh64_hexdigest(b)

    assert got == {i: None if t is None else plain_hash(t) for i, t in duck.execute("select doc_id, text from documents").fetchall()}


def test_online_clusters(spark, sf_dir):
    """Faces within a scope and then clusters across scopes, each met in order, one at a time."""
    faces = {r["id"]: np.array(r["embedding"], dtype=float) for r in Library(spark, sf_dir).media_faces.select("id", "embedding").collect()}

    def meet(clusters, first, vector, count):
        likeness, k = max(((float(c[1] @ vector), -k) for k, c in enumerate(clusters)), default=(0.0, 0))
        if clusters and likeness >= 0.6:
            name, v, n = clusters[-k]
            v = v * n + vector * count
            clusters[-k] = (name, v / np.linalg.norm(v), n + count)
            return name
        clusters.append((first, vector, count))
        return first

    scopes, of = {}, {}
    for i in sorted(faces):
        of[i] = meet(scopes.setdefault(int(faces[i].argmax()), []), i, faces[i], 1)
    whole, merged = [], {}
    for name, v, n in sorted((c for cs in scopes.values() for c in cs), key=lambda c: c[0]):
        merged[name] = meet(whole, name, v, n)
    got = {r["id"]: r["cluster"] for r in queries.QUERIES["online_clusters"](spark, sf_dir).collect()}
    assert got == {i: merged[c] for i, c in of.items()} and len(set(got.values())) > 1


@pytest.mark.parametrize("seed", [1, 2])
def test_large_scopes_are_met_by_blocks(spark, monkeypatch, seed):
    """Faces that are like nobody don't go through the one task, and clusters are those of meeting all in order."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 12))
    x = np.concatenate([rng.normal(size=(300, 12)), centres[rng.integers(0, 40, 150)] + rng.normal(size=(150, 12)) * 0.8, np.eye(1, 12) * np.ones((5, 1))])
    x = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    for module, name, value in ((online_clusters, "FEW", 20), (online_clusters, "BLOCK", 64)):
        monkeypatch.setattr(module, name, value)
    in_order, met = online_clusters.in_order, []
    monkeypatch.setattr(online_clusters, "in_order", lambda nodes, least: (met.append(nodes.count()), in_order(nodes, least))[1])
    faces = spark.createDataFrame([(i, v.tolist(), "one") for i, v in enumerate(x)] + [(900, None, "one"), (901, [float("nan")] * 12, "one")], "id long, embedding array<double>, of string")
    got = {r["id"]: r["cluster"] for r in people.cluster_online(faces, 0.8, "of").collect()}
    clusters, want = [], {900: 900, 901: 901}
    for i, v in enumerate(x):
        likeness, k = max(((float(c[1] @ v), -k) for k, c in enumerate(clusters)), default=(0.0, 0))
        if likeness >= 0.8:
            name, c, n = clusters[-k]
            clusters[-k] = (name, (c * n + v) / np.linalg.norm(c * n + v), n + 1)
            want[i] = name
        else:
            clusters.append((i, v, 1))
            want[i] = i
    assert got == want and len(clusters) < 400
    assert max(met) < len(x)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["period", "count", "cover_id", "cover_file_path", "cover_file_hash"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
