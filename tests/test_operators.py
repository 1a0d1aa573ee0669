from collections import Counter

import pytest

from quillgrid.functions import containers, prompts, validators
from quillgrid.operators import permutation, raster
from quillgrid.streaming.events import fold_stream, folded, latest


@pytest.mark.parametrize("w,h", [(1, 1), (1, 7), (7, 1), (2, 2), (5, 3), (8, 8), (64, 64), (64, 52), (13, 40)])
def test_curve_is_a_path_through_every_cell(w, h):
    cells = raster.curve(w, h)
    assert Counter(cells) == Counter((x, y) for x in range(w) for y in range(h))
    jumps = sum(max(abs(a - c), abs(b - d)) > 1 for (a, b), (c, d) in zip(cells, cells[1:]))
    assert jumps == 0


def test_shift_of_the_worked_example():
    assert raster.shift(12288, 1.0) == 7594


def test_png_rejects_damage():
    png = containers.png_bytes("x" * 50)
    assert [c["type"] for c in containers.chunk_list(png)] == ["IHDR", "iTXt", "IDAT", "IEND"]
    assert containers.chunk_list(png[:-1]) is None and containers.chunk_list(b"no") is None and containers.chunk_list(None) is None
    bad = bytearray(png)
    bad[60] ^= 1
    assert not all(c["crc_ok"] for c in containers.chunk_list(bytes(bad)))


def test_tail_needs_its_magic(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(b"body", "rec")], "c binary, r string")
    whole = containers.with_tail(F.col("c"), F.col("r"))
    row = df.select(containers.tail_of(whole).alias("a"), containers.tail_of(F.col("c")).alias("b"), containers.tail_of(F.substring(whole, 2, 100)).alias("c")).first()
    assert row["a"] == "rec" and row["b"] is None and row["c"] == "rec"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    import shutil

    folder = tmp_path / "in"
    folder.mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", folder)
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = str(tmp_path / "out")
    fold_stream(spark, str(folder), batch.schema, out, str(tmp_path / "cp")).awaitTermination(60)
    assert Counter(map(tuple, folded(spark, out).collect())) == Counter(map(tuple, latest(batch).collect()))
    # more events: only keys that changed are written again
    more = batch.limit(40).selectExpr("event_id + 1000000 AS event_id", "ts + INTERVAL 400 DAYS AS ts", "user_id", "event_type", "value", "props")
    more.coalesce(1).write.mode("append").parquet(str(folder))
    fold_stream(spark, str(folder), batch.schema, out, str(tmp_path / "cp")).awaitTermination(60)
    assert Counter(map(tuple, folded(spark, out).collect())) == Counter(map(tuple, latest(spark.read.parquet(str(folder))).collect()))
    assert spark.read.parquet(out).where("batch = 1").count() == more.select("user_id").distinct().count()


def test_newest_frames_of_a_stream_are_those_of_a_batch(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    from quillgrid.streaming.frames import POLL_MS, newest, stream_newest

    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("epoch", (F.col("event_id") % 3 == 0).cast("int"))
    # ticks that hold several frames, and a late end that closes all of them
    near = events.withColumn("ts", F.timestamp_millis(F.unix_millis(F.lit("2024-01-01").cast("timestamp")) + F.col("event_id") * 37 % 5000))
    end = near.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("epoch", F.lit(1)).withColumn("event_id", F.lit(-1).cast("long"))
    near.write.parquet(str(tmp_path / "in"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(near.schema).parquet(str(tmp_path / "in"))
    stream_newest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), epoch=1).awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", F.floor(F.unix_millis("tick") / POLL_MS).alias("tick"), "event_id", "event_type", "frames")
    want = newest(near.where("epoch = 1"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.where("frames > 1").count()


def test_a_raster_of_one_row_is_permuted_whole(spark):
    from quillgrid.operators import raster as ops
    from quillgrid.plans.catalog import height

    row = spark.createDataFrame([(0, x, x * 3) for x in range(64)], "y long, x int, v int")
    assert height(row) == 1 and height(row.limit(0)) == 0
    moved = ops.scramble(row, 64, height(row))
    assert moved.count() == 64 and sorted(map(tuple, ops.scramble(moved, 64, 1, back=True).select("y", "x", "v").collect())) == [(0, x, x * 3) for x in range(64)]
    assert [tuple(r) for r in moved.orderBy("x").collect()] != [(0, x, x * 3) for x in range(64)]


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['quillgrid.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'mosaic' in e.queries() and not any(q.startswith('op1') for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)


def test_chaotic_orders_against_a_plain_version():
    import numpy as np

    x, lines = 0.41, []
    for _ in range(5):
        values = [x]
        for _ in range(6):
            values.append(3.9999999 * values[-1] * (1 - values[-1]))
        x = values[-1]
        lines.append(sorted(range(7), key=lambda j: (values[j], j)))
    assert permutation.chaotic_orders(0.41, 7, 5, True).tolist() == lines
    assert permutation.chaotic_orders(0.41, 7, 3, False).tolist() == [lines[0]] * 3
    assert np.array_equal(permutation.chaotic_orders(0.41, 1, 3, True), np.zeros((3, 1)))


@pytest.mark.parametrize("w,h,block", [(1, 1, 8), (64, 64, 16), (37, 21, 8), (5, 40, 32)])
def test_permutations_use_every_place_once(w, h, block):
    for source in (permutation.blocks(w, h, "0" * 32, block), permutation.chaotic(w, h, 0.2, True), permutation.chaotic(w, h, 0.2, False, False)):
        assert sorted(source.tolist()) == list(range(w * h))


def test_draws_follow_the_generator():
    draw, state = permutation.draws("00000001" + "0" * 24), 1
    for _ in range(20):
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        assert draw(2**16) == state % 2**16


def test_zip_reads_zip64_and_rejects_what_is_not_whole():
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"x" * 100)
        z.writestr("b", "y")
    ok, whole = validators.judged(validators.check_zip), held.getvalue()
    assert ok(whole) and ok(b"PK\5\6" + bytes(18))
    assert not any(map(ok, (whole[:-1], b"z" + whole, whole + b"z", b"", None, whole.replace(b"PK\3\4", b"PK\3\5"))))


def test_mp4_sizes():
    box = lambda kind, data=b"", size=None: (len(data) + 8 if size is None else size).to_bytes(4, "big") + kind + data
    ok, head = validators.judged(validators.check_mp4), box(b"ftyp", b"isom0000") + box(b"moov")
    assert ok(head + box(b"mdat", b"x")) and ok(head + box(b"mdat", b"tail", 0)) and ok(head + box(b"mdat", (20).to_bytes(8, "big") + b"data", 1))
    assert not ok(head) and not ok(head + box(b"mdat", b"x", 99)) and not ok(head + box(b"mdat", b"x", 7)) and not ok(box(b"ftyp") + box(b"moov") + box(b"mdat"))


def test_safetensors_rules():
    def made(header: str, payload: int) -> bytes:
        return len(header).to_bytes(8, "little") + header.encode() + bytes(payload)

    ok = validators.judged(validators.safetensors_header)
    one = '{"a":{"dtype":"F16","shape":[2,3],"data_offsets":[0,12]}'
    assert ok(made(one + "}", 12)) and ok(made(one + ',"__metadata__":{"k":"v"}}', 12)) and ok(made("{}", 0))
    wrong = ((one + "}", 13), (one + "}", 11), (one + "," + one[1:] + "}", 12), (one.replace("F16", "F17") + "}", 12), (one.replace("[0,12]", "[1,13]") + "}", 13), (one.replace("[2,3]", "[2,2]") + "}", 12), ("[]", 0), (one, 12))
    assert not any(ok(made(*w)) for w in wrong)


def test_cleaners_keep_pictures_and_orientation():
    import struct

    clean = validators.cleaned(validators.clean_jpeg)
    tiff = b"MM" + struct.pack(">HIHHHIHHI", 42, 8, 1, 0x112, 3, 1, 6, 0, 0)
    part = lambda marker, data: b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data
    scan = part(0xDA, b"h") + b"\x01\xff\x00\xff\xd0\x02"
    out = clean(b"\xff\xd8" + part(0xE0, b"JFIF\0rest") + part(0xE1, b"Exif\0\0" + tiff) + part(0xE1, b"http") + part(0xFE, b"note") + scan + b"\xff\xd9tail")
    assert out.endswith(scan + b"\xff\xd9") and b"JFIF" in out and b"note" not in out and b"http" not in out
    assert validators.orientation(out[out.index(b"Exif\0\0") + 6 :]) == 6
    assert clean(b"\xff\xd8\xff\xda") is None and clean(None) is None and validators.orientation(b"") == 1
    gif = b"GIF89a\1\0\1\0\0\0\0"
    loop, note, image = b"\x21\xff\x0bNETSCAPE2.0\x03\1\0\0\0", b"\x21\xfe\x02hi\0", b"\x2c" + bytes(9) + b"\x02\x01\x44\0"
    assert validators.cleaned(validators.clean_gif)(gif + loop + note + image + b"\x3bx") == gif + loop + image + b"\x3b"
    assert validators.cleaned(validators.clean_gif)(gif + image) is None


def test_parameter_lines():
    text = 'a cat, (best:1.2)\nNegative prompt: bad\nworse\nSteps: 20, Seed: 18446744073709551615, Note: "a, Size: 3", Hashes: {"x": 1, y: 2}, Size: 5x6'
    prompt, negative, fields = prompts.parse_parameters(text)
    assert (prompt, negative) == ("a cat, (best:1.2)", "bad\nworse")
    assert fields == {"Steps": "20", "Seed": "18446744073709551615", "Note": "a, Size: 3", "Hashes": '{"x": 1, y: 2}', "Size": "5x6"}
    assert prompts.parse_parameters("Steps: 3") == ("Steps: 3", "", {}) and prompts.parse_parameters(None) == ("", "", {})


def test_code_symbols_follow_the_standard():
    from quillgrid.functions import qr

    # worked examples of the standard's literature: check bytes, format bits, version bits, alignment places, capacities
    assert list(qr.check_bytes(bytes([32, 91, 11, 120, 209, 114, 220, 77, 67, 64, 236, 17, 236, 17, 236, 17]), 10)) == [196, 35, 39, 119, 235, 215, 231, 226, 93, 23]
    assert (16 << 10 | qr.remainder(16, qr.FORMAT_CODE, 10)) ^ qr.FORMAT_XOR == 0b001011010001001
    assert 7 << 12 | qr.remainder(7, qr.VERSION_CODE, 12) == 0x07C94
    assert qr.centres(32) == [6, 34, 60, 86, 112, 138] and qr.centres(40) == [6, 30, 58, 86, 114, 142, 170]
    assert [qr.capacity(v)[1] for v in (1, 2, 7, 40)] == [9, 16, 66, 1276]
    for text in ("a", "http://a.b/ß", "x" * 300, "y" * 1100):
        for mask in (-1, 0, 7):
            assert qr.read(qr.encode(text, mask)) == text


def test_graph_texts():
    import json

    from quillgrid.functions.graphs import sampler_texts, side

    n = lambda kind, **inputs: {"class_type": kind, "inputs": inputs}
    graph = {
        "1": n("KSampler", positive=["2", 0], negative=["3", 1], steps=1, cfg=1, seed=2**64 - 1),
        "2": n("ControlNetApply", positive=["4", 0], negative=["5", 0], strength=1.0),
        "3": n("ControlNetApply", positive=["4", 0], negative=["5", 0]),
        "4": n("Odd", anything=["6", 0]), "5": n("CLIPTextEncode", text="bad"), "6": n("Text Join", a="x", b="y", separator="; "),
        "7": n("BasicGuider", conditioning=["4", 0]), "8": n("SamplerCustomAdvanced", guider=["7", 0], latent_image=["9", 0]),
        "9": n("Loop", text=["9", 0]), "10": n("FancySampler", conditioning=["11", 0]), "11": n("ConditioningZeroOut", conditioning=["4", 0]),
    }
    got = {s["node"]: (s["positive"], s["negative"]) for s in sampler_texts(json.dumps(graph))}
    assert got == {"1": ("x; y", "bad"), "8": ("x; y", ""), "10": ("[ConditioningZeroOut：该分支置零]", "")}
    saved = {
        "nodes": [
            {"id": 1, "type": "KSampler", "inputs": [{"name": "positive", "link": 7}], "widgets_values": [5, "fixed", 20, 7.0]},
            {"id": 2, "type": "CLIPTextEncode", "widgets_values": ["a cat"], "outputs": [{"name": "CONDITIONING"}]},
        ],
        "links": [[7, 2, 0, 1, 0, "CONDITIONING"]],
    }
    assert [(s["node"], s["positive"], s["upstream"]) for s in sampler_texts("{}", json.dumps(saved))] == [("1", "a cat", 2)]
    assert sampler_texts("not json") == sampler_texts(None) == sampler_texts("[]") == []
    assert [side(x) for x in ("negative_prompt", "Pos Prompt", "conditioning +", "conditioning -", "seed")] == [-1, 1, 1, -1, 0]


def test_more_cleaners():
    import struct
    import zlib

    from quillgrid.functions import cleaners, metadata
    from quillgrid.functions.containers import chunk_list, png_bytes

    exif = struct.pack(">2sHIHHHIHHI", b"MM", 42, 8, 1, 0x112, 3, 1, 6, 0, 0)
    chunks = [(c["type"], c["data"]) for c in chunk_list(png_bytes("note"))]
    out = chunk_list(cleaners.clean_png(cleaners.png_of([chunks[0], ("eXIf", exif), *chunks[1:]])))
    assert [c["type"] for c in out] == ["IHDR", "eXIf", "IDAT", "IEND"] and validators.orientation(out[1]["data"]) == 6
    assert validators.cleaned(cleaners.clean_png)(png_bytes("n")[:-20] + b"x" + png_bytes("n")[-19:]) is None
    part = lambda kind, data: kind + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    riff = lambda body: b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body
    head = part(b"VP8X", bytes([0x3C]) + bytes(9))
    got = dict(cleaners.riff_parts(cleaners.clean_webp(riff(head + part(b"VP8L", b"abc") + part(b"EXIF", b"Exif\0\0" + exif) + part(b"XMP ", b"secret")))))
    assert list(got) == [b"VP8X", b"VP8L", b"EXIF"] and got[b"VP8X"][0] == 0x38 and validators.orientation(got[b"EXIF"]) == 6
    assert dict(cleaners.riff_parts(cleaners.clean_webp(riff(head + part(b"XMP ", b"secret")))))[b"VP8X"][0] == 0x30
    assert validators.cleaned(cleaners.clean_webp)(riff(head)[:-1]) is None

    box = lambda kind, data=b"": (len(data) + 8).to_bytes(4, "big") + kind + data
    film = box(b"ftyp", b"isom0000") + box(b"moov", box(b"mvhd", bytes(4) + b"DATEDATE" + b"rest") + box(b"meta", b"who") + box(b"uuid", cleaners.XMP_UUID + b"x")) + box(b"mdat", b"meta")
    done = validators.cleaned(cleaners.clean_mp4)(film)
    assert len(done) == len(film) and b"DATE" not in done and b"who" not in done and b"rest" in done and done.endswith(b"mdatmeta") and done.count(b"free") == 2
    assert validators.cleaned(cleaners.clean_mp4)(film + box(b"pssh")) is None and validators.cleaned(cleaners.clean_mp4)(film[:-1]) is None

    one = lambda kind, data: kind + bytes([0x80 | len(data)]) + data
    tags, info = bytes.fromhex("1254c367"), bytes.fromhex("1549a966")
    mkv = one(b"\x1a\x45\xdf\xa3", b"head") + b"\x18\x53\x80\x67\xff" + one(info, one(b"\x7b\xa9", b"Title") + one(b"\x44\x89", b"dura")) + one(tags, b"tagged") + one(b"\x1f\x43\xb6\x75", b"frames")
    done = validators.cleaned(cleaners.clean_ebml)(mkv)
    assert len(done) == len(mkv) and not any(w in done for w in (b"Title", b"tagged")) and b"dura" in done and b"frames" in done
    assert [k for k, *_ in cleaners.elements(done, 14, len(done))][1:] == [0xEC, 0x1F43B675] and validators.cleaned(cleaners.clean_ebml)(mkv[:-1]) is None

    def old(kind, flags, rest=b"", data=b""):
        body = struct.pack("<BHH", kind, flags, 7 + len(rest)) + rest
        return struct.pack("<H", zlib.crc32(body) & 0xFFFF) + body + data

    def new(body, data=b""):
        sized = bytes([len(body)]) + body
        return struct.pack("<I", zlib.crc32(sized)) + sized + data

    ok, mark = validators.judged(cleaners.check_rar), b"Rar!\x1a\7"
    rar4 = mark + b"\0" + old(0x73, 0, bytes(6)) + old(0x74, 0x8000, struct.pack("<I", 3) + bytes(21), b"abc") + old(0x7B, 0)
    rar5 = mark + b"\1\0" + new(bytes([1, 0, 0])) + new(bytes([2, 2, 3]), b"abc") + new(bytes([5, 0, 0]))
    assert ok(rar4) and ok(rar5) and not ok(rar5[:-8]) and not ok(rar4[:25]) and not ok(mark + b"\2")
    assert not ok(mark + b"\0" + old(0x73, 1, bytes(6))) and not ok(mark + b"\1\0" + new(bytes([1, 0, 1])) + new(bytes([5, 0, 0]))) and not ok(rar5.replace(bytes([2, 2, 3]), bytes([2, 2, 4])))

    fields = metadata.text_fields(cleaners.png_of([chunks[0], ("tEXt", b"Name\0one"), ("tEXt", b"name\0two"), ("zTXt", b"z\0\0" + zlib.compress(b"packed")), ("zTXt", b"bad\0\0x"), *chunks[1:]]))
    assert fields == {"name": "two", "z": "packed", "text": "note"}
    assert metadata.text_fields(b"GIF89a") is None and metadata.text_fields(None) is None


def test_reveal_opacity_is_the_least_error(spark):
    import random

    from quillgrid.operators import reveal

    rng = random.Random(5)
    rows = [(tuple(rng.uniform(127.5, 255) for _ in range(3)), tuple(rng.uniform(0, 127.5) for _ in range(3))) for _ in range(60)]
    df = spark.createDataFrame([(*w, *b) for w, b in rows], "wr double, wg double, wb double, br double, bg double, bb double")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(reveal.opacity([F.col(f"w{c}") for c in "rgb"], [F.col(f"b{c}") for c in "rgb"])).collect()]

    def error(w, b, a):
        p = [min(a, max(0, (x + y - 255 + a) / 2)) for x, y in zip(w, b)]
        return sum((q + 255 - a - x) ** 2 + (q - y) ** 2 for q, x, y in zip(p, w, b))

    for (w, b), a in zip(rows, got):
        assert error(w, b, a) <= min(error(w, b, k / 4) for k in range(1021)) + 1e-9


def test_history_and_suppression(spark):
    from quillgrid.operators.regions import mean_thresholds, suppressed
    from quillgrid.streaming.history import History, replayed

    h = History()
    for i in range(60):
        h.apply("push", (i, 1))
    assert len(h.undo) == 50 and h.undo[0][0] == 10 and h.apply("undo", (60, 1)) == 59 and h.apply("redo", (59, 1)) == 60
    assert h.apply("undo", (60, 1)) == 59 and h.apply("push", (61, 1)) is None and not h.redo and h.apply("redo", (0, 1)) is None
    h.apply("push", (62, 300 * 2**20))
    assert h.undo == [(62, 300 * 2**20)]
    rows = [(k, i, "push" if i < 3 else "undo", 1) for k in "ab" for i in range(5)]
    got = sorted(map(tuple, replayed(spark.createDataFrame(rows, "k string, id long, action string, bytes long"), "k", ["id"]).collect()))
    assert [r[1:] for r in got if r[0] == "b"] == [(0, None, 1, 0), (1, None, 2, 0), (2, None, 3, 0), (3, 2, 2, 1), (4, 1, 1, 2)]

    boxes = [(0, 1, 0.9, 0, 0, 10, 10), (0, 2, 0.8, 1, 1, 11, 11), (0, 3, 0.7, 2, 8, 12, 18), (1, 4, 0.1, 1, 1, 11, 11), (0, 5, 0.8, 0, 9, 10, 19)]
    df = spark.createDataFrame(boxes, "image int, box_id int, score double, left int, top int, right int, bottom int")
    assert sorted(r.box_id for r in suppressed(df, "image").collect()) == [1, 4, 5]

    low = [[10, 10, 10, 10, 10, 10]] * 6
    blocks = [(0, y, x, low[y][x], 200 if x == 0 else 11, 100) for y in range(6) for x in range(6)]
    out = {(r.gy, r.gx): r.threshold for r in mean_thresholds(spark.createDataFrame(blocks, "image long, gy int, gx int, low int, high int, mean int")).collect()}
    point = [[100 if x == 0 else 0 for x in range(6)] for _ in range(6)]
    for y in range(6):
        for x in range(1, 6):
            point[y][x] = 5
            if y and (n := (point[y - 1][x] + 2 * point[y][x - 1] + point[y - 1][x - 1]) // 4) > 10:
                point[y][x] = n
    near = lambda i: range(min(3, max(2, i)) - 2, min(3, max(2, i)) + 3)
    assert out == {(y, x): sum(point[a][b] for a in near(y) for b in near(x)) // 25 for y in range(6) for x in range(6)}


def test_pictures_and_packages():
    import io
    import zipfile

    import numpy as np

    from quillgrid.functions import images, packaging
    from quillgrid.functions.containers import png_bytes

    rng = np.random.default_rng(3)
    for shape in ((1, 1, 4), (7, 5, 4), (40, 90, 4)):
        for a in (rng.integers(0, 256, shape, np.uint8), np.add.outer(np.arange(shape[0]), np.arange(shape[1]))[..., None].repeat(4, 2).astype(np.uint8)):
            assert (images.pictures(images.png(a))[0] == a).all()
            cover, real = images.pictures(images.dual_png(255 - a, a))
            assert (cover == 255 - a).all() and (real == a).all()
    frames = [rng.integers(0, 256, (30, 20, 4), np.uint8) for _ in range(2)]
    made = images.gif(frames, 100)
    kinds = [(k, a, b) for k, a, b in validators.gif_segments(made)]
    assert [k for k, *_ in kinds] == [b"head", b"NETSCAPE2.0", b"\xf9", b"image", b"\xf9", b"image", b"end"] and kinds[-1][2] == len(made)
    a, b = kinds[3][1:]
    data, at = b"", a + 11
    while made[at]:
        data += made[at + 1 : at + 1 + made[at]]
        at += 1 + made[at]
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    codes = bits[: len(bits) // 9 * 9].reshape(-1, 9) @ (1 << np.arange(9))
    codes = codes[: list(codes).index(257)]
    f = frames[0].reshape(-1, 4).astype(int)
    assert (codes[codes < 256] == (f[:, 0] >> 5 << 5 | f[:, 1] >> 5 << 2 | f[:, 2] >> 6)).all()

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.txt", "hello" * 50)
        with z.open("b", "w", force_zip64=True) as g:
            g.write(b"x" * 100)
    jpeg = b"\xff\xd8\xff\xda\x00\x02\xaa\xbb\xff\xd9"
    for mode, cover in (("png", png_bytes("c")), ("jpeg", jpeg), ("behind", jpeg), ("behind", png_bytes("c"))):
        carrier = packaging.PACKERS[mode](cover, held.getvalue(), "n.zip")
        assert packaging.unpack(carrier) == ("restored.zip" if mode == "behind" else "n.zip", held.getvalue())
        with zipfile.ZipFile(io.BytesIO(carrier)) as z:  # also opens as it is
            assert z.read("a.txt") == b"hello" * 50
        damaged = bytearray(carrier)
        damaged[-len(held.getvalue()) // 2] ^= 1
        if mode != "behind":
            assert validators.cleaned(packaging.unpack)(bytes(damaged)) is None
    assert validators.cleaned(lambda c: packaging.pack_png(c, b"no archive", "n"))(png_bytes("c")) is None


def test_source_colours_against_plain_arithmetic(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from quillgrid.operators import reveal

    rng = random.Random(9)
    rows = [(i, *(rng.randrange(256) for _ in range(6))) for i in range(80)] + [(80, 0, 0, 0, 0, 0, 0), (81, 255, 255, 255, 255, 255, 255)]
    df = spark.createDataFrame(rows, "i long, lr int, lg int, lb int, dr int, dg int, db int")
    cols = lambda n: [F.col(n + c) for c in "rgb"]
    lit = lambda v: F.lit(float(v))
    got = {r.i: (r.alpha, r.red, r.green, r.blue) for r in reveal.source_coloured(df, cols("l"), cols("d"), (lit(20), lit(240)), lit(0.8), lit(0.55), lit(30), "i").collect()}
    byte = lambda v: max(0, min(255, math.floor(v + 0.5)))
    for i, *v in rows:
        light, dark = v[:3], v[3:]
        luma = lambda c: (299 * c[0] + 587 * c[1] + 114 * c[2]) / 1000
        y, k = luma(dark), 0.8 * 0.55
        at = y * 0.55
        if max(dark) > min(dark):
            k = min(k, 30 / (max(dark) - min(dark)))
        for c in dark:
            k = min(k, (255 - at) / (c - y) if c > y else -at / (c - y) if c < y else 1)
        black = [at + (c - y) * max(0, k) for c in dark]
        white = 185 + 51 * max(0, min(1, (luma(light) - 20) / 220))
        a = max(math.ceil(max(black)), byte(255 + sum(black) / 3 - white))
        assert got[i] == (a, *(byte(b * 255 / a) if a else 0 for b in black))


def test_crc_of_chunks(spark, sf_dir):
    import zlib

    from quillgrid.plans import catalog

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = catalog.crc_chunk(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all(r.crc == zlib.crc32(b"tEXt" + texts[r.doc_id].encode()) for r in rows)
