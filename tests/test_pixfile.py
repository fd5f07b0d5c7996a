"""Codecs and files: exact round trips, damage, pruning, parts."""

import hypothesis
import hypothesis.strategies as st
import numpy as np
import pandas as pd
import pytest

from lumenframe.operators import codecs, manifests
from lumenframe.sources import pixfile, pixsink

LAYOUTS = ["native", "interchange"]


@hypothesis.settings(max_examples=150, deadline=None)
@hypothesis.given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 300)), max_size=20), st.sampled_from(LAYOUTS), st.sampled_from([0, 1, 2, 3]))
def test_bytes_round_trip(runs, layout, codec):
    data = b"".join(bytes([b]) * n for b, n in runs)
    assert codecs.decode(codecs.encode(data, codec, None, layout), len(data), codec, None, layout) == data
    packed = codecs.run_encode(np.frombuffer(data, np.uint8), layout)
    assert codecs.run_decode(packed, len(data), layout).tobytes() == data


def test_run_coding_bytes():
    given = np.frombuffer(b"AAAABCD", np.uint8)
    assert codecs.run_encode(given) == bytes([253]) + b"A" + bytes([2]) + b"BCD"
    assert codecs.run_encode(given, "interchange") == bytes([3]) + b"A" + bytes([253]) + b"BCD"


def test_float24():
    v = np.array([0, -0.0, 1, 1 + 2**-16, 3.4e38, np.inf, -np.inf, np.nan, 1e-42], np.float32)
    back = codecs.from_float24(codecs.to_float24(v))
    assert np.isnan(back[7]) and back[5] == np.inf and back[6] == -np.inf and np.isfinite(back[4])
    assert back[3] == np.float32(1 + 2**-15) and np.allclose(back[:3], v[:3])


def test_damage_is_found():
    data = bytes(range(200)) * 5
    for codec in (codecs.RLE, codecs.ZIP):
        packed = codecs.encode(bytes(1000), codec)
        with pytest.raises(codecs.CorruptChunk):
            codecs.decode(packed[:-3], 1000, codec)
    with pytest.raises(codecs.CorruptChunk):
        codecs.decode(data[:-1], len(data), codecs.NONE)
    for bad in (b"", b"12345678", b"v/1\x01\x02\0\0\0ab"):
        with pytest.raises(ValueError):
            pixfile.parse_file(bad)


def images(spark, n=2, w=21, h=37):
    rng = np.random.default_rng(7)
    rows = [(f"im{i}", i % 1, y - 3, x + 5, float(np.float16(rng.normal())), float(np.float32(rng.normal())), int(rng.integers(0, 2**32))) for i in range(n) for y in range(h) for x in range(w)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image", "part", "y", "x", "H", "F", "U"])), rows


KINDS = {"H": codecs.HALF, "F": codecs.FLOAT, "U": codecs.UINT}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("tile", [None, (8, 16)])
@pytest.mark.parametrize("codec", [c for c in codecs.SUPPORTED if c not in (codecs.B44, codecs.B44A)])
def test_pixels_round_trip(spark, tmp_path, codec, tile, layout):
    frame, rows = images(spark)
    form = pixsink.Layout(KINDS, codec, tile, layout)
    done = pixsink.save(pixsink.assemble(pixsink.pack_pixels(frame, form), form), str(tmp_path)).collect()
    assert len(done) == 2
    read = pixfile.files(spark, str(tmp_path))
    got = pixfile.pixels(read, ["H", "F", "U", "absent"]).toPandas().sort_values(["path", "y", "x"])
    want = pd.DataFrame(rows, columns=["image", "part", "y", "x", "H", "F", "U"]).sort_values(["image", "y", "x"])
    assert np.array_equal(got[["y", "x", "H", "U"]].to_numpy(), want[["y", "x", "H", "U"]].to_numpy())
    f = want["F"].to_numpy().astype(np.float32)
    assert np.array_equal(got["F"], codecs.from_float24(codecs.to_float24(f)) if codec == codecs.PXR24 else f)
    assert got["absent"].isna().all()
    some = pixfile.pixels(read, ["H"], rows=(4, 6)).toPandas()
    assert sorted(set(some["y"])) == [4, 5, 6] and len(some) == 2 * 3 * 21


def test_missing_pixels_are_zero_and_extra_columns_go(spark):
    frame = spark.createDataFrame([("a", 0, 0, 0, 1.0, "x"), ("a", 0, 40, 3, 2.0, None)], "image string, part int, y bigint, x bigint, V double, tx string")
    form = pixsink.Layout({"V": codecs.FLOAT}, codecs.ZIP)
    whole = pixsink.assemble(pixsink.pack_pixels(frame, form), form).withColumnRenamed("image", "path")
    got = pixfile.pixels(whole, ["V"]).toPandas()
    assert len(got) == 41 * 4 and got["V"].sum() == 3
    assert pixsink.assemble(pixsink.pack_pixels(frame.limit(0), form), form).count() == 0


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("tile", [None, (8, 4)])
@pytest.mark.parametrize("codec", [codecs.NONE, codecs.RLE, codecs.ZIPS, codecs.ZIP])
def test_deep_round_trip(spark, codec, tile, layout):
    rng = np.random.default_rng(3)
    rows = [("d", 0, y, x, s, float(np.float32(rng.normal())), float(np.float16(rng.random()))) for y in range(40) if y not in range(10, 32) for x in range(11) for s in range(rng.integers(0, 4))]
    frame = spark.createDataFrame(pd.DataFrame(rows, columns=["image", "part", "y", "x", "s", "Z", "A"]))
    form = pixsink.Layout({"Z": codecs.FLOAT, "A": codecs.HALF}, codec, tile, layout)
    whole = pixsink.assemble(pixsink.pack_samples(frame, form, ["s"]), form, deep=True).withColumnRenamed("image", "path")
    got = pixfile.deep_samples(whole, ["Z", "A"]).toPandas().sort_values(["y", "x", "s"])
    assert np.array_equal(got[["y", "x", "s", "Z", "A"]].to_numpy(), np.array([r[2:] for r in rows], float))


def test_parts_attributes_and_chunks(spark):
    frame, _ = images(spark, n=1)
    both = frame.unionByName(frame.selectExpr("image", "1 AS part", "y", "x", "H", "F", "U"))
    form = pixsink.Layout(KINDS, codecs.ZIP, attributes={"odd": ("newtype", b"\x01\x02")})
    whole = pixsink.assemble(pixsink.pack_pixels(both, form), form, names=["left", "right"]).withColumnRenamed("image", "path")
    assert [(r["part"], r["name"], r["kind"], r["chunks"], r["miny"], r["maxx"]) for r in pixfile.parts(whole).orderBy("part").collect()] == [(0, "left", "scanlineimage", 3, -3, 25), (1, "right", "scanlineimage", 3, -3, 25)]
    assert pixfile.pixels(whole, ["H"]).count() == 2 * 37 * 21
    odd = pixfile.attributes(whole).where("name = 'odd'").collect()
    assert [(r["type"], bytes(r["value"])) for r in odd] == [("newtype", b"\x01\x02")] * 2
    assert pixfile.chunks(whole).count() == 6
    assert pixfile.summaries(whole).collect()[0]["channels"] == "F,H,U"


@pytest.mark.parametrize("flat", [False, True])
def test_blocks(flat):
    rng = np.random.default_rng(1)
    smooth = (1 + np.arange(16) / 64 + rng.normal(0, 0.001, (200, 16))).astype(np.float16)
    same = np.repeat(rng.normal(size=(50, 1)), 16, axis=1).astype(np.float16)
    wild = rng.normal(0, 100, (50, 16)).astype(np.float16)
    for values, error in ((smooth, 0.02), (same, 0), (wild, None)):
        packed = codecs.block_encode(values.view(np.uint16), flat)
        assert {len(p) for p in packed} == ({3} if flat and values is same else {14})
        bits, at = codecs.block_decode(b"".join(packed), 0, len(values))
        back = bits.view(np.float16).astype(float)
        assert at == sum(map(len, packed)) and np.isfinite(back).all()
        if error is not None:
            assert np.abs(back - values.astype(float)).max() <= error
    special = np.full((1, 16), np.inf, np.float16)
    assert codecs.block_decode(b"".join(codecs.block_encode(special.view(np.uint16), flat)), 0, 1)[0].view(np.float16).max() == 0


def test_b44_keeps_other_channels(spark):
    frame, rows = images(spark, n=1)
    for codec in (codecs.B44, codecs.B44A):
        form = pixsink.Layout(KINDS, codec)
        whole = pixsink.assemble(pixsink.pack_pixels(frame, form), form).withColumnRenamed("image", "path")
        got = pixfile.pixels(whole, ["H", "F", "U"]).toPandas().sort_values(["y", "x"])
        want = pd.DataFrame(rows, columns=["image", "part", "y", "x", "H", "F", "U"]).sort_values(["y", "x"])
        assert np.array_equal(got[["F", "U"]].to_numpy(), want[["F", "U"]].to_numpy()) and np.corrcoef(got["H"], want["H"])[0, 1] > 0.9


def test_manifests():
    groups = [manifests.Group(["id"], ["name"], {7: ["a"], 2: ["é", ""], 2**64 - 1: []}, 1, "MurmurHash3_32", "id"), manifests.Group([], [])]
    assert manifests.decode(manifests.encode(groups)) == groups
    assert manifests.murmur3_128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19) and manifests.murmur3_128(b"") == (0, 0)
    for bad in (b"", b"x", manifests.encode(groups)[:-4]):
        with pytest.raises(ValueError):
            manifests.decode(bad)


def test_channels_of_views():
    channels = [pixfile.Channel(n, codecs.HALF) for n in ("B", "G", "R", "Z", "fg.R", "fg.right.A", "right.G", "right.R")]
    listed = b"".join(len(v).to_bytes(4, "little") + v for v in (b"left", b"right"))
    found = pixfile.view_channels(pixfile.Part({"multiView": ("stringvector", listed)}, channels))
    assert found == {"left": {"b": "B", "g": "G", "r": "fg.R"}, "right": {"a": "fg.right.A", "g": "right.G", "r": "right.R"}}
    assert pixfile.view_channels(pixfile.Part({"view": ("string", b"left")}, channels)) == {"left": {"b": "B", "g": "G", "r": "R"}}
    assert pixfile.view_channels(pixfile.Part({}, channels)) == {}


def test_dct_chunks_with_lossy_channels_are_told():
    data = bytes(range(200)) * 4
    packed = codecs.encode(data, codecs.DWAA)
    assert codecs.decode(packed, len(data), codecs.DWAA) == data
    with pytest.raises(NotImplementedError):
        codecs.decode(packed[:24] + b"\1" + packed[25:], len(data), codecs.DWAA)
