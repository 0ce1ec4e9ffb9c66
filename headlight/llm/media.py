"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized by integral images, as NPY tiles with difference hashes.

`decode` reads P1 to P6 (8-bit) and uncompressed BMP of 1, 4, 8, 24 or 32 bits. `store` writes one row per input row:
the media bytes, an NPY tile and its hash; `load` reads media as columns of samples, `digests` their digests. Payloads become
samples (kinds ppm and bmp; a null payload counts as empty and is padded like any other) or are media themselves (kind as_is; null
stays null). Equal payloads give equal rows; media that are null or cannot be decoded give null tile, hash, samples and digests;
extra columns are not taken along; an empty table gives an empty result. A row's memory is a few times its own size.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from headlight.llm.common import ready, scratch

UNIT, WIDTH, TILE = 192, 8, 16
_token = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_ppm(samples: np.ndarray) -> bytes:
    """H x W x 3 to binary PPM (P6), H x W to binary PGM (P5)."""
    kind = b"P6" if samples.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _token.match(data, at)
        head.append(int(m[1]))
        at = m.end()
    w, h, most = (*head, 1)[:3]
    if w <= 0 or h <= 0 or not 0 < most < 256:
        raise ValueError("unsupported Netpbm header")
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (h, w, 3) if depth == 3 else (h, w)
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*|[^01]", b"", data[at:]), np.uint8)[: w * h] - 48
        return ((1 - bits) * np.uint8(255)).reshape(shape)
    if kind in (b"P2", b"P3"):
        x = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * depth], np.int64).reshape(shape)
    else:
        x = np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(shape)
    return x.astype(np.uint8) if most == 255 else (x.astype(np.int64) * 255 // most).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, head = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    w, h = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, packed = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if bits not in (1, 4, 8, 24, 32) or packed not in (0, 3) or w <= 0 or h == 0:
        raise ValueError("unsupported BMP")
    rows = np.frombuffer(data, np.uint8, abs(h) * ((w * bits + 31) // 32 * 4), start).reshape(abs(h), -1)
    if bits >= 24:
        x = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    else:
        index = np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits) @ (1 << np.arange(bits)[::-1]) if bits < 8 else rows
        palette = np.frombuffer(data[14 + head : start], np.uint8).reshape(-1, 4)[:, 2::-1]
        x = palette[index[:, :w]]
    return np.ascontiguousarray(x[::-1] if h > 0 else x)


def encode_bmp(samples: np.ndarray) -> bytes:
    """H x W x 3 to 24-bit BMP, bottom row first."""
    h, w, _ = samples.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = samples[::-1, :, ::-1].reshape(h, -1)
    i4 = lambda *x: b"".join(int(v).to_bytes(4, "little") for v in x)
    return b"BM" + i4(54 + rows.size, 0, 54, 40, w, h) + b"\x01\x00\x18\x00" + i4(0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def decoded(data: bytes | None) -> np.ndarray | None:
    """The samples, or None for what is no such medium, is cut short or says nonsense in its header."""
    try:
        return None if data is None else decode(data)
    except (ValueError, TypeError, IndexError):
        return None


def grey(x: np.ndarray) -> np.ndarray:
    """Integer luma with weights 77, 150 and 29 of 256."""
    return x if x.ndim == 2 else ((x @ np.array([77, 150, 29], np.int64)) >> 8).astype(np.uint8)


def area_resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas by an integral image, which is interpolated where a cell's edge cuts a sample."""
    h, w = x.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = x.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        pos = np.arange(m + 1) * n / m
        low = np.minimum(pos.astype(np.int64), n - 1)
        return low, pos - low

    (r, fr), (c, fc) = at(h, height), at(w, width)
    rows = total[r] * (1 - fr)[:, None] + total[r + 1] * fr[:, None]
    cells = rows[:, c] * (1 - fc) + rows[:, c + 1] * fc
    return np.diff(np.diff(cells, axis=0), axis=1) / (h * w / (height * width))


def difference_hash(x: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 x 9 area means is darker than its right neighbour."""
    small = np.round(area_resize(grey(x), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, x, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def padded(payload: bytes) -> bytes:
    """Bytes 32 appended up to a positive multiple of 192."""
    return payload + b" " * (max(1, -(-len(payload) // UNIT)) * UNIT - len(payload))


def wrap(payload: bytes, kind: str = "ppm") -> bytes:
    """A padded payload as the samples of an RGB image 8 wide."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return encode_bmp(x) if kind == "bmp" else encode_ppm(x)


def store(df: DataFrame, key: str, payload: str, kind: str = "ppm", path: str | None = None) -> str:
    """Writes key, n_bytes, media, tile (NPY) and hash as Parquet and returns the folder."""
    ready(df.sparkSession)
    path = path or scratch(df.sparkSession)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch, rows = big.slice(at, 1000), []
                for x in batch.column(1):
                    raw = x.as_py()
                    raw = raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw
                    media = raw if kind == "as_is" else wrap(padded(raw or b""), kind)
                    image = decoded(media)
                    tile = None if image is None else npy(np.round(area_resize(grey(image), TILE, TILE)).astype(np.uint8))
                    rows.append((len(raw or b""), media, tile, None if image is None else difference_hash(image)))
                n, media, tiles, hashes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.binary()), pa.array(hashes, pa.string())], names=[key, "n_bytes", "media", "tile", "hash"])

    schema = f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, media binary, tile binary, hash string"
    df.select(key, payload).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return path


def load(stored: DataFrame, key: str) -> DataFrame:
    """key, height, width, depth (3 or 1) and samples (bytes, row by row) of stored media, nulls where they cannot be decoded."""
    ready(stored.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                image = decoded(x.as_py())
                rows.append((None,) * 4 if image is None else (*image.shape[:2], 1 if image.ndim == 2 else 3, image.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, "height", "width", "depth", "samples"])

    return stored.select(key, "media").mapInArrow(run, f"{key} {stored.schema[key].dataType.simpleString()}, height int, width int, depth int, samples binary")


def digests(stored: DataFrame, key: str) -> DataFrame:
    """Decodes stored media: payload and media lengths and digests, the tile's checksum, and the difference hash of what was read."""
    ready(stored.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for n, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                media, tile = x.as_py(), y.as_py()
                stored_as = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
                if (image := decoded(media)) is None:
                    rows.append((n, None, None, None, *stored_as, None, None))
                    continue
                payload = image.tobytes()
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored_as, difference_hash(image), zlib.crc32(tile)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[key, *NAMES])

    kind = stored.schema[key].dataType.simpleString()
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_crc32 long"
    return stored.select(key, "n_bytes", "media", "tile").mapInArrow(run, f"{key} {kind}, {fields}")


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_crc32"]
