"""Bytes of still images: PNG of 8 and 16 bits and half-float EXR scanlines, decoded and encoded as whole NumPy arrays.

What a file holds and is not read here raises `Refused`, whose text says what was found.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the two formats.
PNG_MARK, EXR_MARK = b"\x89PNG\r\n\x1a\n", b"v/1\x01"
PNG_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
EXR_FLAGS = {0x200: "tiled", 0x800: "deep", 0x1000: "multi-part"}
EXR_LINES = {0: 1, 2: 1, 3: 16}  # rows a chunk: stored, deflated rows, deflated groups of rows
EXR_PACKING = ("NONE", "RLE", "ZIPS", "ZIP", "PIZ", "PXR24", "B44", "B44A", "DWAA", "DWAB")
EXR_HALF = 1
REC709 = (0.64, 0.33, 0.30, 0.60, 0.15, 0.06, 0.3127, 0.3290)  # x and y of red, green, blue and white


class Refused(ValueError):
    """The file is damaged or of a kind that is not read."""


class Short(Refused):
    """The bytes end before what is needed; more of the file may help."""


def png_chunks(raw: bytes):
    """(kind, data) of a PNG's chunks; a checksum that is wrong is refused."""
    at = 8
    while at + 12 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        data = raw[at + 8 : at + 8 + size]
        if at + 12 + size > len(raw):
            break
        if zlib.crc32(kind + data) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise Refused(f"PNG chunk {kind.decode('latin-1')} has a wrong checksum")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise Short("PNG file is truncated")


def decode_png(raw: bytes) -> np.ndarray:
    """(height, width, 3) levels of uint8 or uint16; grey is spread over three channels, alpha is dropped."""
    if raw[:8] != PNG_MARK:
        raise Refused("not a PNG file")
    found = list(png_chunks(raw))
    width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", found[0][1])
    if depth not in (8, 16) or colour not in PNG_CHANNELS or laced:
        raise Refused(f"PNG of {depth} bits, colour type {colour}{', interlaced' if laced else ''} is not read")
    channels = PNG_CHANNELS[colour]
    step = channels * depth // 8
    flat = np.frombuffer(zlib.decompress(b"".join(d for k, d in found if k == b"IDAT")), np.uint8)
    if flat.size != height * (width * step + 1):
        raise Refused(f"PNG holds {flat.size} bytes, expected {height * (width * step + 1)}")
    lines = flat.reshape(height, -1)
    pixels = _unfilter(lines[:, 0], lines[:, 1:].reshape(height, width, step))
    values = pixels.reshape(height, width, channels) if depth == 8 else np.ascontiguousarray(pixels).view(">u2").astype(np.uint16)
    return values[..., [0, 0, 0]] if channels < 3 else values[..., :3]


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the row filters along diagonals: a pixel needs its left, upper and upper left neighbours, so those of equal
    row + column are independent, and an image takes rows + columns steps whatever its filters."""
    height, width, step = lines.shape
    if kinds.max(initial=0) > 4:
        raise Refused(f"PNG row filter {kinds.max()} is unknown")
    out = np.zeros((height + 1, width + 1, step), np.int16)
    if not np.isin(kinds, (1, 3, 4)).any():  # no row looks to its left: rows as wholes
        total = lines.astype(np.int16)
        for y in range(height):
            out[y + 1, 1:] = (total[y] + (out[y, 1:] if kinds[y] else 0)) & 255
        return out[1:, 1:].astype(np.uint8)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        base = left + up - corner
        nl, nu, nc = np.abs(base - left), np.abs(base - up), np.abs(base - corner)
        paeth = np.where((nl <= nu) & (nl <= nc), left, np.where(nu <= nc, up, corner))
        kind = kinds[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)
        out[y + 1, x + 1] = (lines[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode_png(levels: np.ndarray, effort: int = 6) -> bytes:
    """PNG of (height, width, 3) levels: plain rows for 8 bits, differences to the row above for 16."""
    if levels.ndim != 3 or levels.shape[2] != 3 or levels.dtype not in (np.uint8, np.uint16):
        raise Refused(f"a master has rows of RGB in 8 or 16 bits, not {levels.shape} of {levels.dtype}")
    height, width, _ = levels.shape
    lines = levels.astype(">u2").view(np.uint8).reshape(height, -1) if levels.dtype == np.uint16 else levels.reshape(height, -1)
    up = levels.dtype == np.uint16
    rows = np.empty((height, lines.shape[1] + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = 2 * up, lines
    if up:
        rows[1:, 1:] -= lines[:-1]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8 * levels.dtype.itemsize, 2, 0, 0, 0)
    return PNG_MARK + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), effort)) + part(b"IEND", b"")


def exr_header(raw: bytes) -> dict:
    """Size, origin, channels, packing and where the offsets of the chunks begin; `Short` if the header goes on."""
    if raw[:4] != EXR_MARK[: len(raw[:4])] or not raw:
        raise Refused("not an EXR file")
    values: dict[str, bytes] = {}
    try:
        version = struct.unpack_from("<I", raw, 4)[0]
        at = 8
        while raw[at]:
            name_end = raw.index(b"\0", at)
            kind_end = raw.index(b"\0", name_end + 1)
            size = struct.unpack_from("<i", raw, kind_end + 1)[0]
            if size < 0:
                raise Refused("EXR attribute of a negative size")
            name, start = raw[at:name_end].decode("latin-1"), kind_end + 5
            at = start + size
            values[name] = raw[start:at]
            if at >= len(raw):
                raise Short("EXR header is truncated")
    except (struct.error, IndexError, ValueError) as end:
        raise end if isinstance(end, Refused) else Short("EXR header is truncated") from None
    if version & 0xFF != 2 or (kinds := [k for bit, k in EXR_FLAGS.items() if version & bit]):
        raise Refused(f"EXR of version {version & 0xFF} is not read" if version & 0xFF != 2 else f"{kinds[0]} EXR is not read")
    if lost := [k for k in ("channels", "compression", "dataWindow", "displayWindow") if k not in values]:
        raise Refused(f"EXR header has no {lost[0]}")
    packing = values["compression"][0]
    if packing not in EXR_LINES:
        raise Refused(f"EXR packing {EXR_PACKING[packing] if packing < len(EXR_PACKING) else packing} is not read")
    if values["dataWindow"] != values["displayWindow"]:
        raise Refused("EXR is cropped: its data window is not its display window")
    left, top, right, bottom = struct.unpack("<4i", values["dataWindow"])
    if right < left or bottom < top:
        raise Refused("EXR data window is empty")
    names = []
    try:
        rest = values["channels"]
        while rest[0]:
            name, rest = rest.split(b"\0", 1)
            kind, _, across, down = struct.unpack_from("<iB3xii", rest)
            if kind != EXR_HALF or (across, down) != (1, 1):
                raise Refused(f"EXR channel {name.decode('latin-1')} is {'subsampled' if kind == EXR_HALF else 'not of half floats'}")
            names.append(name.decode("latin-1"))
            rest = rest[16:]
    except (struct.error, IndexError, ValueError) as bad:
        raise bad if isinstance(bad, Refused) else Refused("EXR channel list is malformed") from None
    if gone := [c for c in "RGB" if c not in names]:
        raise Refused(f"EXR has no channel {gone[0]}")
    lines, height = EXR_LINES[packing], bottom - top + 1
    return {"width": right - left + 1, "height": height, "top": top, "channels": names, "packing": EXR_PACKING[packing], "lines": lines, "offsets": at + 1, "chunks": -(-height // lines)}


def exr_unpack(block: bytes, size: int) -> np.ndarray:
    """A chunk's bytes: inflated, running sums of the differences, the two halves interleaved; stored if not smaller."""
    if len(block) < size:
        try:
            steps = np.frombuffer(zlib.decompress(block), np.uint8)
        except zlib.error:
            raise Refused("EXR chunk is damaged") from None
        if steps.size == size:
            sums = np.add.accumulate(steps.astype(np.int64) - 128 * (np.arange(size) > 0)).astype(np.uint8)
            return sums.reshape(2, -1).T.reshape(-1)  # rows of half floats have an even number of bytes
        block = steps.tobytes()
    if len(block) != size:
        raise Refused(f"EXR chunk holds {len(block)} bytes, expected {size}")
    return np.frombuffer(block, np.uint8)


def exr_pack(plain: np.ndarray, effort: int) -> bytes:
    """The inverse of `exr_unpack`."""
    steps = np.diff(plain.reshape(-1, 2).T.reshape(-1).astype(np.int16), prepend=0)
    steps[1:] += 128
    packed = zlib.compress(steps.astype(np.uint8).tobytes(), effort)
    return packed if len(packed) < plain.size else plain.tobytes()


def exr_rows(head: dict, block: bytes, y: int) -> np.ndarray:
    """(rows, width, 3) half codes of a chunk that begins at row y of the file's window."""
    first = y - head["top"]
    if not 0 <= first < head["height"] or first % head["lines"]:
        raise Refused(f"EXR chunk starts at row {y}, outside the image")
    rows = min(head["lines"], head["height"] - first)
    shape = (rows, len(head["channels"]), head["width"])
    size = 2 * int(np.prod(shape))
    plain = exr_unpack(block, size) if head["packing"] != "NONE" else np.frombuffer(block, np.uint8)
    if plain.size != size:
        raise Refused(f"EXR chunk holds {plain.size} bytes, expected {size}")
    return plain.view("<u2").reshape(shape)[:, [head["channels"].index(c) for c in "RGB"]].transpose(0, 2, 1)


def encode_exr(codes: np.ndarray, effort: int = 1) -> bytes:
    """EXR of (height, width, 3) half codes: one part, B, G and R, deflated groups of 16 rows."""
    if codes.ndim != 3 or codes.shape[2] != 3 or codes.dtype != np.uint16:
        raise Refused(f"an EXR master has rows of RGB half codes, not {codes.shape} of {codes.dtype}")
    height, width, _ = codes.shape
    window = np.array([0, 0, width - 1, height - 1], "<i4").tobytes()
    channels = b"".join(c + b"\0" + struct.pack("<iB3xii", EXR_HALF, 0, 1, 1) for c in (b"B", b"G", b"R")) + b"\0"
    fields = (
        ("channels", "chlist", channels), ("chromaticities", "chromaticities", np.array(REC709, "<f4").tobytes()), ("compression", "compression", b"\3"), ("dataWindow", "box2i", window),
        ("displayWindow", "box2i", window), ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)), ("screenWindowCenter", "v2f", bytes(8)), ("screenWindowWidth", "float", struct.pack("<f", 1)),
    )
    head = EXR_MARK + struct.pack("<I", 2) + b"".join(f"{n}\0{k}\0".encode() + struct.pack("<i", len(v)) + v for n, k, v in fields) + b"\0"
    lines = np.ascontiguousarray(codes[..., ::-1].transpose(0, 2, 1)).astype("<u2").view(np.uint8).reshape(height, -1)
    blocks = [exr_pack(lines[y : y + 16].reshape(-1), effort) for y in range(0, height, 16)]
    blocks = [struct.pack("<ii", 16 * i, len(b)) + b for i, b in enumerate(blocks)]
    places = np.cumsum([len(head) + 8 * len(blocks), *map(len, blocks[:-1])]).astype("<u8")
    return head + places.tobytes() + b"".join(blocks)


def half_levels() -> np.ndarray:
    """The display level, 0 to 255, of each half code: the sRGB curve of its value; NaN and below zero 0, from one 255."""
    with np.errstate(invalid="ignore"):
        x = np.nan_to_num(np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(float), nan=0.0, posinf=1.0, neginf=0.0).clip(0, 1)
    return (np.where(x <= 0.0031308, x * 12.92, 1.055 * x ** (1 / 2.4) - 0.055) * 255).astype(np.float32)


def level_halves() -> np.ndarray:
    """The half code of the linear value of each 16-bit level."""
    x = np.arange(1 << 16) / 65535
    return np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4).astype(np.float16).view(np.uint16)
