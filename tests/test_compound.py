"""Compound files built by hand: large and small streams, packed and plain sections, damaged chains."""

import io
import os
import struct
import zipfile
import zlib

import pytest

from matchloom.sources import compound, files

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def record(text):
    payload = text.encode("utf-16-le")
    return struct.pack("<I", 67 | (min(len(payload), 0xFFF) << 20)) + (struct.pack("<I", len(payload)) if len(payload) >= 0xFFF else b"") + payload


def build(streams, shift=9):
    """A compound file of {(folder, name) or (name,): bytes}; siblings hang on one another to the right."""
    sector = 1 << shift
    small = b""
    small_fat, sectors, fat = [], [], []

    def put(data):
        first = len(sectors)
        parts = [data[i : i + sector].ljust(sector, b"\0") for i in range(0, len(data), sector)]
        sectors.extend(parts)
        fat.extend([*range(first + 1, first + len(parts)), END])
        return first

    placed = {}
    for path, data in streams.items():
        if len(data) >= 4096:
            placed[path] = put(data)
        else:
            first = len(small_fat)
            count = max(1, -(-len(data) // 64))
            small_fat.extend([*range(first + 1, first + count), END])
            placed[path] = first
            small += data.ljust(64 * count, b"\0")
    folders = sorted({p[0] for p in streams if len(p) == 2})
    names = ["Root Entry", *folders, *[p[-1] for p in streams]]
    number = {p: 1 + len(folders) + i for i, p in enumerate(streams)}
    under = {f: [number[p] for p in streams if len(p) == 2 and p[0] == f] for f in folders}
    top = [*(1 + i for i in range(len(folders))), *(number[p] for p in streams if len(p) == 1)]
    right = {a: b for group in (top, *under.values()) for a, b in zip(group, group[1:])}
    small_at = put(small) if small else END
    table = b""
    for i, name in enumerate(names):
        raw = name.encode("utf-16-le") + b"\0\0"
        kind = 5 if i == 0 else 1 if i <= len(folders) else 2
        path = next((p for p, n in number.items() if n == i), None)
        child = (top[0] if top else FREE) if i == 0 else under[names[i]][0] if kind == 1 else FREE
        start, size = (small_at, len(small)) if i == 0 else (placed[path], len(streams[path])) if path else (0, 0)
        table += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", FREE, right.get(i, FREE), child) + bytes(36) + struct.pack("<IQ", start & 0xFFFFFFFF, size)
    directory = put(table)
    small_table = put(b"".join(struct.pack("<I", n) for n in small_fat).ljust(sector, b"\xff")) if small_fat else END
    tables = -(-(len(fat) + 1) * 4 // sector)
    while (len(fat) + tables) * 4 > tables * sector:
        tables += 1
    first = len(fat)
    fat += [FAT] * tables
    whole = b"".join(struct.pack("<I", n) for n in fat).ljust(tables * sector, b"\xff")
    sectors.extend(whole[i : i + sector] for i in range(0, len(whole), sector))
    head = compound.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, shift, 6) + bytes(6) + struct.pack("<III", 0, tables, directory) + struct.pack("<IIIIII", 0, 4096, small_table, 1, END, 0)
    head += struct.pack("<109I", *[*range(first, first + tables), *[FREE] * (109 - tables)])
    return head.ljust(sector, b"\0") + b"".join(sectors)


def packed(data):
    press = zlib.compressobj(wbits=-15)
    return press.compress(data) + press.flush()


def document(sections, compressed=True):
    head = bytes(36) + struct.pack("<I", int(compressed)) + bytes(216)
    body = {("BodyText", f"Section{i}"): packed(s) if compressed else s for i, s in sections.items()}
    return build({("FileHeader",): head, ("DocInfo",): b"x", **body})


LONG = "긴 문단 " * 2000


@pytest.mark.parametrize("compressed", [True, False])
def test_sections_in_order(compressed):
    data = document({10: record("열째"), 0: record("첫째 문단") + record(LONG), 2: record("둘째")}, compressed)
    assert files.attachment_text("a.hwp", data) == "첫째 문단\n" + LONG.strip() + " \n둘째\n열째"


def test_large_sectors_and_streams():
    noise = os.urandom(30_000)
    for shift in (9, 12):
        box = compound.Compound(build({("FileHeader",): b"h" * 70, ("BodyText", "Section0"): noise, ("Other", "tiny"): b"", ("Other", "edge"): b"e" * 4095}, shift))
        assert box.read(("BodyText", "Section0")) == noise and box.read(("FileHeader",)) == b"h" * 70
        assert box.read(("Other", "tiny")) == b"" and box.read(("Other", "edge")) == b"e" * 4095


def test_damaged_files_are_empty():
    """Cut files, loops in chains and in the directory, wild numbers: an empty text, and no endless loop."""
    good = document({0: record(LONG), 1: record("둘")})
    assert files.attachment_text("a.hwp", good)
    fat_at = struct.unpack_from("<I", good, 76)[0]
    for cut in (0, 8, 100, 511, 512, 700, len(good) // 2):
        assert files.attachment_text("a.hwp", good[:cut]) == ""
    for i in range(0, 128):
        loop = bytearray(good)
        struct.pack_into("<I", loop, (fat_at + 1) * 512 + 4 * (i % 60), i % 7)
        files.attachment_text("a.hwp", bytes(loop))
    directory = struct.unpack_from("<I", good, 48)[0]
    for entry in range(5):
        for field in (68, 72, 76, 116):
            for value in (0, 1, 3, 4_000_000_000, 77):
                wild = bytearray(good)
                struct.pack_into("<I", wild, (directory + 1) * 512 + entry * 128 + field, value)
                files.attachment_text("a.hwp", bytes(wild))
    itself = bytearray(good)
    struct.pack_into("<I", itself, (directory + 1) * 512 + 128 + 72, 1)  # the first folder is its own sibling
    assert files.attachment_text("a.hwp", bytes(itself)) == ""


def test_archive_names(spark, tmp_path):
    """Documents in an archive stand below their names, which are code page 949 where the archive doesn't say so."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("직무기술서.hwp".encode("cp949").decode("cp437"), document({0: record("본문 " + "가" * 300)}))
        z.writestr("skip.txt", "no document")
        z.writestr("b.hwp", document({0: record("둘째")}))
    (tmp_path / "직무기술서 묶음.zip").write_bytes(box.getvalue())
    (tmp_path / "one.hwp").write_bytes(document({0: record("하나")}))
    got = {os.path.basename(r.path): r for r in files.attachments(spark, str(tmp_path)).collect()}
    assert got["직무기술서 묶음.zip"].text == "[직무기술서.hwp]\n본문 " + "가" * 300 + "\n\n[b.hwp]\n둘째" and got["직무기술서 묶음.zip"].usable
    assert got["one.hwp"].text == "하나" and not got["one.hwp"].usable
