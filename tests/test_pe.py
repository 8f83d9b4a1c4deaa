"""The program-feature extractor on images built here by the published layout."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkquarry.operators import forest
from sparkquarry.sources import files, pe


def image(overlay=b"tail" * 10, wide=True):
    """A small image with a code and a data section; the data section holds one import table."""
    opt_size = 240 if wide else 224
    head = bytearray(0x400)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 60, 0x80)
    head[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", head, 0x84, 0x8664 if wide else 0x14C, 2, 1234567, 0, 0, opt_size, 0x22)
    opt = 0x98
    struct.pack_into("<HBB", head, opt, 0x20B if wide else 0x10B, 14, 2)
    struct.pack_into("<I", head, opt + 16, 0x1000)
    struct.pack_into("<H", head, opt + 68, 3)
    struct.pack_into("<H", head, opt + 70, 0x4160)
    struct.pack_into("<I", head, opt + (108 if wide else 92), 16)
    dirs = opt + (112 if wide else 96)
    struct.pack_into("<II", head, dirs + 8, 0x2000, 40)
    table = opt + opt_size
    struct.pack_into("<8sIIIIIIHHI", head, table, b".text", 0x180, 0x1000, 0x200, 0x400, 0, 0, 0, 0, 0x60000020)
    struct.pack_into("<8sIIIIIIHHI", head, table + 40, b".data", 0x400, 0x2000, 0x200, 0x600, 0, 0, 0, 0, 0xC0000040)
    code = bytes(range(256)) * 2
    data = bytearray(0x200)
    struct.pack_into("<IIIII", data, 0, 0x2060, 0, 0, 0x2040, 0x2060)
    data[0x40:0x4D] = b"KERNEL32.dll\0"
    w = 8 if wide else 4
    struct.pack_into("<" + ("Q" if wide else "I") * 3, data, 0x60, 0x20A0, (1 << (8 * w - 1)) | 7, 0)
    data[0xA0:0xB0] = b"\0\0VirtualAlloc\0\0"
    return bytes(head) + code + bytes(data) + overlay


@pytest.mark.parametrize("wide", [True, False])
def test_features(wide):
    f = pe.extract(image(wide=wide))
    assert (f["coff_num_sections"], f["opt_subsystem"], f["opt_entrypoint"], f["coff_char_EXECUTABLE_IMAGE"], f["coff_char_DLL"]) == (2, 3, 0x1000, 1, 0)
    assert (f["opt_dllchar_NX_COMPAT"], f["opt_dllchar_GUARD_CF"], f["opt_dllchar_NO_SEH"]) == (1, 1, 0)
    assert (f["num_sections"], f["num_exec_sections"], f["num_write_sections"], f["num_rwx_sections"]) == (2, 1, 1, 0)
    assert f["sec0_entropy"] == pytest.approx(8.0) and f["sec1_vr_ratio"] == 2.0 and f["sec2_vsize"] == 0
    assert (f["num_import_dlls"], f["num_import_functions"], f["num_import_by_name"], f["num_import_by_ordinal"], f["num_suspicious_imports"]) == (1, 2, 1, 1, 1)
    assert f["imphash"] == int(hashlib.md5(b"kernel32.virtualalloc,kernel32.ord7").hexdigest()[:8], 16)
    assert sum(abs(f[f"imp_func_hash_{i}"]) for i in range(256)) == 1 and sum(abs(f[f"sec_name_hash_{i}"]) for i in range(32)) in (0, 2)
    assert f["has_overlay"] == 1 and f["overlay_size"] == 40 and f["overlay_entropy"] == pytest.approx(1.5) or f["overlay_entropy"] == pytest.approx(2.0)


def test_damage_and_limits():
    broken = bytearray(image())
    broken[0x600:0x604] = b"\xff\xff\xff\xff"  # import table points nowhere
    f = pe.extract(bytes(broken))
    assert f["num_import_functions"] == 0 and f["num_sections"] == 2
    for bad in (b"", b"MZ" + b"\0" * 600, b"x" * 1000):
        with pytest.raises(ValueError):
            pe.extract(bad)
    with pytest.raises(ValueError, match="resource_limit"):
        pe.extract(image(), pe.Limits(largest=600))
    with pytest.raises(ValueError, match="nope"):
        pe.resolve(["file_size", "nope"])
    assert pe.entropy(b"") == 0.0 and pe.entropy(b"aaaa") == 0.0 and pe.entropy(b"ab") == 1.0


def test_files_to_decisions(spark, tmp_path):
    rng = np.random.default_rng(0)
    for i in range(12):
        (tmp_path / f"f{i}.exe").write_bytes(image(overlay=rng.bytes(20 + i * 10)))
    (tmp_path / "bad.exe").write_bytes(b"not a program" * 100)
    names = ["overlay_size", "sec_mean_entropy", "overlay_entropy"]
    x = pe.extracted(files.raw_files(spark, f"file://{tmp_path}", [".exe"]), names)
    assert x.filter("not parse_ok").count() == 1 and x.filter("parse_ok").count() == 12
    good = x.filter("parse_ok")
    means, scales = forest.fit_scaler(good, names, ["overlay_size"])
    model = forest.fit_forest(good, "path", names, forest.ForestConfig(trees=10, max_samples=12, continuous=True))
    model.threshold = -0.55
    out = forest.raw_inference(good, model, "path", ["overlay_size"], means, scales)
    assert out.filter(F.col("is_anomaly").isNotNull()).count() == 12
