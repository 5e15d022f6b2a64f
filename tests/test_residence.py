import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrove.operators import correlation, residence
from kinetrove.plans import prefix, staging

RNG = np.random.default_rng(7)
LONG = {1: (RNG.random(300) < 0.6).astype(int), 2: (RNG.random(300) < 0.2).astype(int), 3: np.ones(300, int)}
LONG[1][40:120] = 1  # an event over several chunks


def occ_of(spark, objects, run="r"):
    rows = [(run, o, f, int(h)) for o, bits in objects.items() for f, h in enumerate(bits)]
    return spark.createDataFrame(rows, "run_id string, object_id int, frame_id bigint, h int")


def bits(text):
    return [int(c) for c in text]


def read_back(df):
    out = {}
    for r in df.orderBy("object_id", "frame_id").collect():
        out.setdefault(r.object_id, []).append(r.h)
    return out


def events_by_hand(h):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], h, [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2])]


def fill_by_hand(h, tol):
    h = np.array(h)
    ones = np.flatnonzero(h)
    for a, b in zip(ones[:-1], ones[1:]):
        if b - a - 1 <= tol:
            h[a:b] = 1
    return h.tolist()


@pytest.mark.parametrize("text,tol,want", [
    ("1001", 1, "1001"), ("1001", 2, "1111"), ("0110", 5, "0110"), ("1111", 3, "1111"), ("0000", 3, "0000"), ("1", 1, "1"),
    ("1010100", 1, "1111100"), ("1010", 0, "1010"),
])
def test_gap_fill_cases(spark, text, tol, want):
    assert read_back(residence.fill_gaps(occ_of(spark, {1: bits(text)}), tol))[1] == bits(want)


@pytest.mark.parametrize("tol,chunk", [(1, 4), (2, 8), (3, 4096), (7, 4)])
def test_gap_fill_over_chunks(spark, tol, chunk):
    occ = occ_of(spark, LONG)
    got = residence.fill_gaps(occ, tol, chunk)
    assert read_back(got) == {o: fill_by_hand(h, tol) for o, h in LONG.items()}
    assert read_back(residence.fill_gaps(got, tol, chunk)) == read_back(got)


@pytest.mark.parametrize("chunk", [2, 5, 4096])
def test_events_over_chunks(spark, chunk):
    got = {}
    for r in residence.residence_events(occ_of(spark, LONG), chunk).collect():
        got.setdefault(r.object_id, []).append((r.start_frame, r.n_frames))
    assert {o: sorted(e) for o, e in got.items()} == {o: events_by_hand(h) for o, h in LONG.items()}


@pytest.mark.parametrize("chunk", [2, 3, 4096])
def test_running_values_over_chunks(spark, chunk):
    v = RNG.integers(0, 100, 200)
    df = spark.createDataFrame([(k, i, int(x)) for k in "ab" for i, x in enumerate(v)], "k string, i bigint, v bigint")
    got = prefix.running(df, ["k"], "i", {
        "s": ("sum", F.col("v")), "m": ("max", F.when(F.col("v") > 50, F.col("v"))), "n": ("min", F.col("v")),
    }, chunk).where("k = 'a'").orderBy("i").collect()
    assert [r.s for r in got] == np.cumsum(v).tolist()
    assert [r.n for r in got] == np.minimum.accumulate(v).tolist()
    big = np.maximum.accumulate(np.where(v > 50, v, -1))
    assert [r.m for r in got] == [None if x < 0 else x for x in big.tolist()]
    ranks = prefix.ordinal(df.where("i % 3 = 1"), ["k"], "i", "pos", chunk).where("k = 'b'").orderBy("i").collect()
    assert [r.pos for r in ranks] == list(range(len(ranks)))


def test_explode_range_blocks(spark):
    df = spark.createDataFrame([(3, 12), (5, 4)], "a bigint, b bigint")
    assert sorted(r.x for r in prefix.explode_range(df, "a", "b", "x", block=4).collect()) == list(range(3, 13))


def curve_by_hand(h, dt):
    n = h.shape[1]
    c = np.array([
        (h[:, : n - l] * h[:, l:]).sum() / h[:, : n - l].sum() if h[:, : n - l].sum() else 0.0 for l in range(n)
    ])
    mean = h.mean()
    r = np.ones(n) if np.isclose(mean, 1) else np.clip((c - mean) / (1 - mean), -1, 1)
    return np.clip(c, 0, 1), r


def test_intermittent_against_brute_force(spark):
    h = np.array(list(LONG.values()))
    c, r = curve_by_hand(h, 1.0)
    occ = occ_of(spark, LONG)
    full = correlation.intermittent(occ).orderBy("lag").collect()
    assert [x.c for x in full] == pytest.approx(c.tolist(), abs=1e-12)
    assert [x.r for x in full] == pytest.approx(r.tolist(), abs=1e-12)
    part = correlation.intermittent(occ, max_lag=20).orderBy("lag").collect()
    assert [x.c for x in part] == pytest.approx(c[:21].tolist(), abs=1e-12)


def test_bounded_counts_over_blocks(spark):
    from kinetrove.operators.fft import bounded_counts

    h = LONG[1]
    ones = occ_of(spark, {1: h}).where("h = 1")
    got = {r.lag: r.num for r in bounded_counts(ones, 10, block=16).collect()}
    assert [got[l] for l in range(11)] == [int((h[: 300 - l] * h[l:]).sum()) for l in range(11)]


def test_curve_of_constant_occupancy(spark):
    always = correlation.intermittent(occ_of(spark, {1: bits("11111")})).collect()
    assert all(x.c == 1.0 and x.r == 1.0 for x in always) and len(always) == 5
    never = correlation.intermittent(occ_of(spark, {1: bits("000")})).collect()
    assert [x.c for x in never] == [0.0] * 3


def test_summary_identities(spark):
    occ = occ_of(spark, LONG)
    dt = 0.5
    s = correlation.mrt_summary(occ, dt).first()
    lengths = [n for h in LONG.values() for _, n in events_by_hand(h)]
    assert (s.n_events, s.n_objects, s.n_frames) == (len(lengths), 3, 300)
    assert s.direct_mrt == pytest.approx(np.mean(lengths) * dt)
    curve = residence.survival(residence.residence_events(occ), dt)
    assert s.continuous_mrt == pytest.approx(sum(r.value for r in curve.collect()) * dt)
    _, r = curve_by_hand(np.array(list(LONG.values())), dt)
    assert s.intermittent_mrt == pytest.approx(r.sum() * dt)
    got = [x.value for x in curve.orderBy("lag").collect()]
    assert got == pytest.approx([np.mean([n >= l for n in lengths]) for l in range(max(lengths) + 1)])


def test_shell_residence(spark):
    occ = occ_of(spark, {5: bits("110101"), 9: bits("001000"), 4: bits("000000"), 7: bits("111111")})
    got = {r.object_id: r for r in residence.shell_residence(occ).collect()}
    assert {o: (r.rt_frames, r.exchanges, r.first_order) for o, r in got.items()} == {5: (4, 2, 1), 9: (1, 1, 3), 7: (6, 0, 2)}
    assert got[7].mrt == got[7].total_rt


def test_occupancy_modes(make_frames):
    f = make_frames([[("O", 0, 0, 0), ("O", 2, 0, 0), ("H", 1, 0, 0), ("H", 9, 0, 0)]])
    read = lambda d: {r.object_id: r.h for r in d.collect()}
    assert read(residence.occupancy(f, [1], [[3], [4]], 1.0)) == {3: 1, 4: 0}
    assert read(residence.occupancy(f, [1, 2], [[3]], 0.1, "geometric_center")) == {3: 1}
    assert read(residence.occupancy(f, [1, 2], [[3], [3, 4]], 0.1, "center_of_mass", "group_list_com")) == {1: 1, 2: 0}
    assert read(residence.occupancy(f, [1], [[3, 4]], 5.0, observed_mode="group_list_geometric")) == {1: 1}
    with pytest.raises(ValueError):
        residence.occupancy(f, [1, 2], [[3]], 1.0)


def test_salted_attach_gives_the_broadcast_result(spark):
    big = spark.range(500).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 7) end as run_id", "id as frame_id")
    small = big.select("run_id").distinct().withColumn("m", F.length("run_id"))
    a = sorted(staging.attach(big, small, ["run_id"]).collect())
    b = sorted(staging.attach(big, small, ["run_id"], limit=0).select("run_id", "frame_id", "m").collect())
    assert a == b and len(a) == 500


def test_autocorrelation_and_psd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(24, 3, 6))
    names = ("x", "y", "z", "vx", "vy", "vz")
    rows = [("r", n, [dict(zip(names, map(float, a))) for a in frame]) for n, frame in enumerate(x)]
    f = spark.createDataFrame(rows, "run_id string, frame_id bigint, pos array<struct<%s>>" % ",".join(f"{c}:double" for c in names))
    n, start, stop = 5, 2, 22
    first = [b for b in range(start - 1, 24, n) if b + 1 <= stop - n]
    want = np.array([[np.mean([(x[b, :, s] * x[b + k, :, s]).sum(axis=1).mean() for b in first]) for k in range(1, n)]
                     for s in (slice(0, 3), slice(3, 6))])
    want /= np.abs(want).max(axis=1, keepdims=True)
    got = correlation.autocorrelation(f, start, stop, n).orderBy("lag").collect()
    assert [r.paf for r in got] == pytest.approx(want[0].tolist())
    assert [r.vaf for r in got] == pytest.approx(want[1].tolist())
    spec = correlation.psd(correlation.autocorrelation(f, start, stop, n), 5.0, 2).orderBy("k").collect()
    assert [r.power for r in spec] == pytest.approx((np.abs(np.fft.fft(want[1])) ** 2).tolist())
    assert correlation.autocorrelation(f, 1, 4, 5).count() == 0
