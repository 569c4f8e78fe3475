import duckdb
import numpy as np

from gridsmith.llm import queries, topk


def plain(rows, asked, k):
    sound = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, v in sound:
        if asked(q):
            best = sorted((-int(v @ w), i) for i, w in sound if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_equal_vectors_ties_and_unsound_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype("float32")]) for i in range(120)]
    rows += [(200 + i, [1.0] * 6) for i in range(40)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (304, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, rank int")
    asked = lambda i: i % 10 == 0
    want = plain([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], asked, 5)
    for shard in (65_536, 30, 7):
        got = topk.top_k(frame, frame.where("vec_id % 10 = 0"), 5, shard).collect()
        assert sorted(tuple(r) for r in got) == want
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id in (0, 1, 2)"), frame.where("vec_id = 0")).count() == 2


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 2.0]), (2, [3.0, 1.0]), (2, [3.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, -1.0])]
    got = sorted(tuple(r) for r in topk.top_k(*[spark.createDataFrame(rows, "vec_id long, embedding array<double>")] * 2, 2).collect())
    one = lambda q: sorted(((-int(a * x + b * y), i) for i, (x, y) in [(i, (256 * x, 256 * y)) for i, (x, y) in rows] if i != q for a, b in [min(v for j, v in [(j, [256 * x, 256 * y]) for j, (x, y) in rows] if j == q)]))[:2]
    assert got == sorted((q, r + 1, i, -s) for q in (1, 2, 3, 4) for r, (s, i) in enumerate(one(q)))


def test_vectors_move_once_whatever_the_number_of_queries(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    sizes = []
    real = topk.cut
    try:
        topk.cut = lambda frame: sizes.append(frame.columns) or real(frame)
        topk.top_k(table, table, 3, 100).count()
    finally:
        topk.cut = real
    assert sizes.count(["size", "shard", "tree"]) == 1 and len(sizes) <= 5


def test_op5_gives_its_sql_rows(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = duck.sql(queries.SQL["op5_top_k"]).fetchall()
    names = [c[0] for c in duck.sql(queries.SQL["op5_top_k"]).description]
    assert names == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in queries.QUERIES["op5_top_k"](spark, sf_dir).collect()) == sorted(want)


def test_branches_that_cannot_win_are_not_opened():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(500, 8)) * 5 + 800, rng.normal(size=(2000, 8)) * 5 - 800]).round()
    shard = topk.Shard(np.arange(2500), points, 6)
    opened = []
    real = shard.tree.points

    class Spy:
        def __getitem__(self, key):
            opened.append(key)
            return real[key]

        def __len__(self):
            return len(real)

    shard.tree.points = Spy()
    shard.search(points[:20], np.arange(20), np.full(20, -np.inf), 5)
    assert sum(k.stop - k.start for k in opened) <= 600
