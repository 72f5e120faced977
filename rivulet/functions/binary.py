"""Bytes: fixed-width numbers and bit fields, checksums, digests, base codes, compression and encryption."""

from __future__ import annotations

import gzip
import lzma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType


def read_uint(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """Unsigned number of size (1 to 7) bytes at a 0-based offset; null if the bytes aren't all there."""
    at = at if isinstance(at, Column) else F.lit(at)
    raw = F.substring(data, at.cast("int") + 1, F.lit(size))
    text = F.hex(raw)
    if little:
        text = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.when(F.length(raw) == size, F.conv(text, 16, 10).cast("long"))


def read_bits(data: Column, at: int, size: int) -> Column:
    """Unsigned number of size (1 to 48) bits at a 0-based bit offset, most significant first."""
    first, last = at // 8, (at + size - 1) // 8
    return F.shiftrightunsigned(read_uint(data, first, last - first + 1), 8 * (last + 1) - at - size).bitwiseAND((1 << size) - 1)


def pack_uint(value: Column, size: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(value), 16, "0"), 17 - 2 * size, 2 * size))


def fourcc(code: Column) -> Column:
    """The four characters of a code point number."""
    return F.decode(pack_uint(code, 4), "UTF-8")


def fourcc_number(text: Column) -> Column:
    return F.conv(F.hex(F.encode(text, "UTF-8")), 16, 10).cast("long")


def _crc_table(polynomial: int = 0x04C11DB7) -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (polynomial if c & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(c)
    return table


def crc32_msb_of(data: bytes, table: list[int] = _crc_table()) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return c


@F.pandas_udf(LongType())
def crc32_msb(data: pd.Series) -> pd.Series:
    """CRC-32 of bytes, most significant bit first, without reflection or a final inversion."""
    table = np.array(_crc_table(), np.int64)
    out = np.full(len(data), 0xFFFFFFFF, np.int64)
    rows = [np.frombuffer(d or b"", np.uint8) for d in data]
    order = np.argsort([-len(r) for r in rows], kind="stable")
    lengths = np.array([len(rows[i]) for i in order])
    # all rows of a batch advance in step, the longest first
    for at in range(int(lengths[0]) if len(rows) else 0):
        live = order[: int(np.searchsorted(-lengths, -at, "left"))]
        b = np.fromiter((rows[i][at] for i in live), np.int64, len(live))
        c = out[live]
        out[live] = ((c << 8) & 0xFFFFFFFF) ^ table[(c >> 24) ^ b]
    return pd.Series(out).where(pd.Series([d is not None for d in data]), None)


@F.pandas_udf(BinaryType())
def compress(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else gzip.compress(d, mtime=0))


@F.pandas_udf(BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    """gzip or xz bytes; null for anything else."""

    def one(d: bytes | None) -> bytes | None:
        try:
            return None if d is None else gzip.decompress(d) if d[:2] == b"\x1f\x8b" else lzma.decompress(d)
        except (OSError, EOFError, lzma.LZMAError):
            return None

    return data.map(one)


def digests(data: Column) -> Column:
    return F.struct(F.md5(data).alias("md5"), F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256"))


def encrypt_subsamples(data: Column, key: Column, iv: Column, clear: int, pattern: tuple[int, int] = (0, 0), block: int = 16) -> Column:
    """array of struct(clear, cipher) slices: `clear` bytes stay as they are, then pattern = (encrypted, skipped) blocks
    repeat (all if (0, 0)); whole blocks only are encrypted, each slice by AES in CBC with the sample's vector. A cipher is as
    long as what it stands for: there is no padding and no vector in it."""
    crypt, skip = pattern
    n = F.greatest(F.length(data) - clear, F.lit(0))
    stride = F.lit((crypt + skip) * block) if crypt else F.greatest(n, F.lit(1))
    most = F.lit(crypt * block) if crypt else n
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1), stride)

    def one(at: Column) -> Column:
        span = F.least(most, n - at)
        whole = span - span % block
        body = F.substring(data, (at + clear + 1).cast("int"), whole.cast("int"))
        rest = F.substring(data, (at + clear + whole + 1).cast("int"), F.least(stride - whole, n - at - whole).cast("int"))
        # the library puts the vector in front and a block of padding behind
        cipher = F.substring(F.aes_encrypt(body, key, F.lit("CBC"), F.lit("PKCS"), iv), F.lit(block + 1), whole.cast("int"))
        return F.struct(rest.alias("clear"), F.when(whole > 0, cipher).alias("cipher"))

    head = F.struct(F.substring(data, 1, clear).alias("clear"), F.lit(None).cast("binary").alias("cipher"))
    return F.concat(F.array(head), F.when(n > 0, F.transform(starts, one)).otherwise(F.array().cast("array<struct<clear:binary,cipher:binary>>")))


def xor_bytes(a: Column, b: Column, size: int) -> Column:
    """a XOR b, of `size` bytes each."""
    spans = [(i, min(4, size - i)) for i in range(0, size, 4)]
    return F.concat(*[pack_uint(read_uint(a, i, n).bitwiseXOR(read_uint(b, i, n)), n) for i, n in spans])


def decrypt_subsamples(parts: Column, key: Column, iv: Column, block: int = 16) -> Column:
    def plain(p: Column) -> Column:
        last = F.substring(p["cipher"], F.length(p["cipher"]) - block + 1, F.lit(block))
        # the block that decrypts to padding behind the last one, which the library asks for
        pad = F.substring(F.aes_encrypt(xor_bytes(last, F.lit(bytes([block] * block)), block), key, F.lit("ECB"), F.lit("PKCS")), F.lit(1), F.lit(block))
        return F.concat(F.coalesce(F.aes_decrypt(F.concat(iv, p["cipher"], pad), key, F.lit("CBC"), F.lit("PKCS")), F.lit(b"")), p["clear"])

    return F.aggregate(F.transform(parts, plain), F.lit(b""), lambda a, b: F.concat(a, b))


def counter_mode(data: Column, key: Column, vector: Column) -> Column:
    """AES in counter mode, for encryption and decryption alike: blocks of a key stream made from vector (8 bytes) and the
    number of the block, from 0."""
    # the first two blocks by the counters 0 and 1; all others in one go, as Galois counter mode counts on from 2 behind 12 bytes
    head = F.substring(F.aes_encrypt(F.concat(vector, F.lit(bytes(8)), vector, F.lit(bytes(7) + b"\x01")), key, F.lit("ECB"), F.lit("PKCS")), 1, 32)
    own = F.substring(F.concat(F.substring(data, 1, 32), F.lit(bytes(32))), 1, 32)
    rest = F.substring(data, F.lit(33), F.length(data))
    # the library puts the vector in front and a tag behind
    tail = F.substring(F.aes_encrypt(rest, key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(vector, F.lit(bytes(4)))), F.lit(13), F.length(rest))
    return F.substring(F.concat(xor_bytes(own, head, 32), F.when(F.length(rest) > 0, tail).otherwise(F.lit(b""))), F.lit(1), F.length(data))


def rolled_key(keys: list[bytes], index: Column, every: int) -> Column:
    """The key of row number `index` if keys change every so many rows."""
    return F.element_at(F.array(*[F.lit(k) for k in keys]), (F.floor(index / every) % len(keys) + 1).cast("int"))


def read_long(data: Column, at: int, little: bool = False) -> Column:
    """Eight bytes at a 0-based offset as a signed number."""
    first, last = read_uint(data, at, 4, little), read_uint(data, at + 4, 4, little)
    return F.shiftleft(last if little else first, 32).bitwiseOR(first if little else last)


def write_bits(fields: list[tuple[Column, int]]) -> Column:
    """Unsigned numbers of given numbers of bits (63 in all at most), the first in the highest bits, filled up to whole bytes."""
    total = sum(n for _, n in fields)
    value = F.lit(0).cast("long")
    for x, n in fields:
        value = F.shiftleft(value, n).bitwiseOR(x.cast("long").bitwiseAND((1 << n) - 1))
    return pack_uint(F.shiftleft(value, -total % 8), -(-total // 8))
