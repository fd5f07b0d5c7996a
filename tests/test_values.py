"""Values against published constants and numpy, beside the comparison with SQL."""

import math

import numpy as np
import pandas as pd

from lumenframe.plans import catalogue, values


def plane(sf):
    return np.stack(pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")["embedding"].to_numpy()).astype(np.float64)


def test_id_hashes(spark):
    spark.createDataFrame([("hello",), ("cube",), ("sphere",), ("plane",), ("",), ("naïve é",)], "name string").createOrReplaceTempView("hash_names")
    sql = f"WITH {values.hashed('hash_names', 'spark')} SELECT name, i, {values._FLOAT} AS id_float FROM (SELECT name, {values._FIXED} AS i FROM m) q".replace("{idiv}", "div")
    got = {r["name"]: (r["i"], r["id_float"]) for r in spark.sql(sql).collect()}
    for name, want in {"hello": 6.07056271024e-17, "cube": -4.08461912519e15, "sphere": 2.79018604383e15, "plane": 3.66557617593e-11}.items():
        assert math.isclose(got[name][1], want, rel_tol=1e-11)
    assert got[""][0] == 1 << 23

    def murmur(data):
        h, cut = 0, len(data) // 4 * 4
        mix = lambda k: ((k * 0xCC9E2D51 % 2**32 << 15 | k * 0xCC9E2D51 % 2**32 >> 17) % 2**32) * 0x1B873593 % 2**32
        for i in range(0, cut, 4):
            h ^= mix(int.from_bytes(data[i : i + 4], "little"))
            h = ((h << 13 | h >> 19) % 2**32 * 5 + 0xE6546B64) % 2**32
        h ^= mix(int.from_bytes(data[cut:], "little")) ^ len(data)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * factor % 2**32
        return h

    assert got["naïve é"][0] in (murmur("naïve é".encode()), murmur("naïve é".encode()) ^ 1 << 23)


def test_lanczos(spark, sf):
    v = plane(sf)
    tap = np.array([2 * math.sin(math.pi * d) * math.sin(math.pi * d / 2) / (math.pi * d) ** 2 for d in (-1.5, -0.5, 0.5, 1.5)])

    def halve(a):
        out = []
        for t in range(a.shape[1] // 2):
            at = [(i, w) for i, w in zip(range(2 * t - 1, 2 * t + 3), tap, strict=True) if 0 <= i < a.shape[1]]
            out.append(sum(a[:, i] * w for i, w in at) / sum(w for _, w in at))
        return np.stack(out, axis=1)

    want = halve(halve(v).T).T
    got = catalogue.QUERIES["agg9_lanczos_downsample"](spark, sf).toPandas()
    first = pd.read_parquet(f"{sf}/embeddings.parquet")["vec_id"].min()
    assert first == 0 and len(got) == want.size
    assert np.allclose(want[got["y2"], got["x2"]], got["v"], atol=2e-5)


def test_dct(spark, sf):
    v = plane(sf).reshape(-1, 8, 8)
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.where(k == 0, math.sqrt(1 / 8), 0.5) * np.cos((2 * n + 1) * k * math.pi / 16)
    want = c @ v @ c.T
    got = catalogue.QUERIES["sc18_dct_forward"](spark, sf).toPandas()
    assert np.allclose(want[got["y"], got["w"], got["u"]], got["c"], atol=2e-5)


def test_half_widening(spark, sf):
    got = catalogue.QUERIES["sc2_half_to_float"](spark, sf).toPandas().dropna()
    assert np.array_equal(got["h"].to_numpy().astype(np.uint16).view(np.float16).astype(np.float64), got["v"])


def test_matrix_of_rec709(spark, sf):
    rows = {r["name"]: r for r in catalogue.QUERIES["sc12_rgb_to_xyz"](spark, sf).collect()}
    assert [round(rows["rec709"][k], 4) for k in ("yr", "yg", "yb")] == [0.2126, 0.7152, 0.0722]


def test_zigzag_order():
    assert values.zigzag()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_adaptation_maps_white_onto_white(spark, sf):
    rows = catalogue.QUERIES["sc13_adaptation_matrix"](spark, sf).where("mode = 'colorimetric'").collect()
    white = {n: np.array([p[3][0] / p[3][1], 1.0, (1 - p[3][0] - p[3][1]) / p[3][1]]) for n, p in values.PRIMARIES.items()}
    assert len(rows) == 4
    for r in rows:
        m = np.array([[r[f"m{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])
        assert np.abs(m @ white[r["source"]] - white[r["target"]]).max() < 1e-5
