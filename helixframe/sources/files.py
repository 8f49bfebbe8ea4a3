"""Python data sources for formats that are not lines: FASTA, FASTQ and BAM, with their writers.

Each file is one partition, read as a stream (gzip and BGZF are decompressed member by member), so a
worker never holds a file. Paths go through pyarrow's file systems (local, hdfs, s3, gs).

    spark.dataSource.register(FastqSource)
    spark.read.format("fastq").load("/data/*.fastq.gz")
"""

from __future__ import annotations

import fnmatch
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_ROWS = 5_000


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what to put before its paths again."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:"), ""
    wild = re.search(r"[*?\[]", path)
    head = path[: wild.start()].rpartition("/")[0] if wild else path
    f, p = fs.FileSystem.from_uri(head)
    return f, p + path[len(head) :], head[: len(head) - len(p)] if head.endswith(p) else path.split("://", 1)[0] + "://"


def list_files(path: str) -> list[str]:
    """Files of a path, a folder or a pattern (``*``, ``?``, ``[..]``) on any file system; hidden ones are left out."""
    f, p, before = _system(path)
    wild = re.search(r"[*?\[]", p)
    if not wild:
        info = f.get_file_info(p)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else f.get_file_info(fs.FileSelector(p))
    else:
        base = p[: wild.start()].rpartition("/")[0] or ("/" if p.startswith("/") else ".")
        every = f.get_file_info(fs.FileSelector(base, recursive=True))
        same = lambda x: x.count("/") == p.count("/") and all(fnmatch.fnmatchcase(y, z) for y, z in zip(x.split("/"), p.split("/")))
        found = [i for i in every if same(i.path)]
    return [before + i.path for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and not re.search(r"(\A|/)[._][^/]*$", i.path)]


def _open(path: str):
    f, p, _ = _system(path)
    return f.open_input_stream(p, compression=None)


def chunks(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """Bytes of a file; gzip of any number of members is inflated. A file that ends inside a member raises."""
    with _open(path) as f:
        data = f.read(size)
        if data[:2] != b"\x1f\x8b":
            while data:
                yield data
                data = f.read(size)
            return
        z, inside = zlib.decompressobj(31), True
        while data:
            yield z.decompress(data)
            if z.eof:
                data = z.unused_data or f.read(size)
                z, inside = zlib.decompressobj(31), bool(data)
            else:
                data = f.read(size)
        if inside:
            raise ValueError(f"truncated gzip: {path}")


def lines(path: str) -> Iterator[str]:
    """Lines without their end; a carriage return is taken off and a last line needs no newline."""
    rest = b""
    for c in chunks(path):
        *full, rest = (rest + c).split(b"\n")
        for x in full:
            yield x.rstrip(b"\r").decode("utf-8", "replace")
    if rest:
        yield rest.rstrip(b"\r").decode("utf-8", "replace")


def fasta_records(rows: Iterator[str]) -> Iterator[tuple[str, list[str]]]:
    """(header, body lines); blank lines are skipped; text before the first header is refused."""
    head, body = None, []
    for r in rows:
        if r.startswith(">"):
            if head is not None:
                yield head, body
            head, body = r[1:], []
        elif r.strip():
            if head is None:
                raise ValueError("text before the first header")
            body.append(r)
    if head is not None:
        yield head, body


def fastq_records(rows: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality). Sequence and quality may be wrapped: as many quality symbols are read as
    there are letters, so a quality line may begin with ``@``. A shortfall or another first mark raises."""
    rows = iter(rows)
    for r in rows:
        if not r.strip():
            continue
        if not r.startswith("@"):
            raise ValueError(f"a record does not begin with @: {r[:60]}")
        seq: list[str] = []
        for x in rows:
            if x.startswith("+"):
                break
            seq.append(x.strip())
        else:
            raise ValueError("unexpected end in a sequence")
        s = "".join(seq)
        qual = ""
        while len(qual) < len(s):
            x = next(rows, None)
            if x is None:
                raise ValueError("unexpected end in a quality")
            qual += x.strip()
        if len(qual) != len(s):
            raise ValueError(f"quality and sequence differ in length: {r[:60]}")
        yield r[1:], s, qual


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str], rows):
        self.path, self.names, self.rows = options["path"], names, rows

    def partitions(self):
        return [_File(x, i) for i, x in enumerate(list_files(self.path))]

    def read(self, partition):
        held: list[tuple] = []
        for r in self.rows(partition.path):
            held.append(r)
            if len(held) >= _ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, held):
        return pa.RecordBatch.from_arrays([pa.array(c) if any(v is not None for v in c) else pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=self.names)


class FastaSource(DataSource):
    """``header, body`` (array of lines)."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "header string, body array<string>"

    def reader(self, schema):
        return _Reader(self.options, ["header", "body"], lambda p: fasta_records(lines(p)))


class FastqSource(DataSource):
    """``seq_id, seq, qual``."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "seq_id string, seq string, qual string"

    def reader(self, schema):
        return _Reader(self.options, ["seq_id", "seq", "qual"], lambda p: fastq_records(lines(p)))


# --- BAM -----------------------------------------------------------------------------------------
_SEQ = "=ACMGRSVTWYHKDBN"
_CIGAR = "MIDNSHP=X"
_TAG = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
BAM_COLUMNS = ["rec_no", "qname", "flag", "ref", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "tlen", "seq", "qual", "tags"]


class _Bytes:
    def __init__(self, path: str):
        self.it, self.buf, self.at = chunks(path), b"", 0

    def take(self, n: int) -> bytes:
        while len(self.buf) - self.at < n:
            c = next(self.it, None)
            if c is None:
                break
            self.buf, self.at = self.buf[self.at :] + c, 0
        out = self.buf[self.at : self.at + n]
        self.at += len(out)
        return out


def _header(b: _Bytes) -> tuple[str, list[tuple[str, int]]]:
    if b.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = b.take(struct.unpack("<i", b.take(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", b.take(4))[0]):
        name = b.take(struct.unpack("<i", b.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", b.take(4))[0]))
    return text, refs


def bam_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (reference, length) pairs of a BAM file."""
    return _header(_Bytes(path))


def _tags(d: bytes) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(d):
        k, t = d[i : i + 2].decode(), chr(d[i + 2])
        i += 3
        if t in _TAG:
            v = struct.unpack_from(_TAG[t], d, i)[0]
            i += struct.calcsize(_TAG[t])
        elif t == "A":
            v, i = chr(d[i]), i + 1
        elif t in "ZH":
            e = d.index(0, i)
            v, i = d[i:e].decode("latin-1"), e + 1
        elif t == "B":
            st, n = chr(d[i]), struct.unpack_from("<i", d, i + 1)[0]
            w = struct.calcsize(_TAG[st])
            v = ",".join(str(struct.unpack_from(_TAG[st], d, i + 5 + w * j)[0]) for j in range(n))
            i += 5 + w * n
        else:
            raise ValueError(f"unknown tag type {t}")
        out.append((k, str(v)))
    return out


def bam_records(path: str) -> Iterator[tuple]:
    """Records as tuples of ``BAM_COLUMNS``; positions are 0-based, missing references and texts None."""
    b = _Bytes(path)
    refs = [r for r, _ in _header(b)[1]]
    no = 0
    while size := b.take(4):
        d = b.take(struct.unpack("<i", size)[0])
        ref, pos, ln, mapq, _, nc, flag, ls, mref, mpos, tlen = struct.unpack_from("<iiBBHHHiiii", d)
        i = 32
        qname = d[i : i + ln - 1].decode()
        i += ln
        cig = "".join(f"{v >> 4}{_CIGAR[v & 15]}" for v in struct.unpack_from(f"<{nc}I", d, i))
        i += 4 * nc
        seq = "".join(_SEQ[x >> 4] + _SEQ[x & 15] for x in d[i : i + (ls + 1) // 2])[:ls]
        i += (ls + 1) // 2
        q = d[i : i + ls]
        qual = None if not ls or q[:1] == b"\xff" else "".join(chr(c + 33) for c in q)
        name = lambda r: refs[r] if r >= 0 else None
        yield (no, None if qname == "*" else qname, flag, name(ref), pos, mapq, cig or None, name(mref), mpos, tlen, seq or None, qual, _tags(d[i + ls :]))
        no += 1


class BamSource(DataSource):
    """Alignment records of BAM files, see ``BAM_COLUMNS``; one task a file (:func:`write_bam_files` writes many)."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return "rec_no bigint, qname string, flag int, ref string, pos bigint, mapq int, cigar string, mate_ref string, mate_pos bigint, tlen int, seq string, qual string, tags map<string,string>"

    def reader(self, schema):
        return _BamReader(self.options, BAM_COLUMNS, bam_records)


class _BamReader(_Reader):
    def read(self, partition):
        """Records of file i are numbered from i * 2 ** 40 on, so that neighbours of one file stay neighbours."""
        at = partition.number << 40
        held: list[tuple] = []
        for r in self.rows(partition.path):
            held.append((at + r[0], *r[1:]))
            if len(held) >= _ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, held):
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=self.names)


def _bin(beg: int, end: int) -> int:
    """Index bin of an interval: the smallest of the nested bins that holds it."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


def _bgzf(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path: str, header: str, refs: list[tuple[str, int]], records: Iterator[tuple]) -> None:
    """Write records (tuples of ``BAM_COLUMNS``; text tags only) as one BAM file on any file system, streaming."""
    ids = {r: i for i, (r, _) in enumerate(refs)}
    system, own, _ = _system(path)
    with system.open_output_stream(own, compression=None) as f:
        h = header.encode()
        buf = io.BytesIO()
        buf.write(b"BAM\1" + struct.pack("<i", len(h)) + h + struct.pack("<i", len(refs)))
        for r, n in refs:
            buf.write(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", n))
        for _, qname, flag, ref, pos, mapq, cigar, mref, mpos, tlen, seq, qual, tags in records:
            q, s = (qname or "*").encode() + b"\0", seq or ""
            ops = [(int(n) << 4) | _CIGAR.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")]
            span = sum(v >> 4 for v in ops if _CIGAR[v & 15] in "MDN=X") or 1
            code = [_SEQ.index(c) for c in s.upper()] + [0] * (len(s) % 2)
            d = struct.pack("<iiBBHHHiiii", ids.get(ref, -1), pos, len(q), mapq, _bin(max(pos, 0), max(pos, 0) + span), len(ops), flag, len(s), ids.get(mref, -1), mpos, tlen)
            d += q + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(code[::2], code[1::2], strict=True))
            d += bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(s)
            for k, v in dict(tags or {}).items():
                d += k.encode() + b"Z" + str(v).encode("latin-1") + b"\0"
            buf.write(struct.pack("<i", len(d)) + d)
            if buf.tell() > 60_000:
                data = buf.getvalue()
                for i in range(0, len(data) - len(data) % 60_000, 60_000):
                    f.write(_bgzf(data[i : i + 60_000]))
                buf = io.BytesIO(data[len(data) - len(data) % 60_000 :])
                buf.seek(0, 2)
        f.write(_bgzf(buf.getvalue()))
        f.write(_bgzf(b""))


def write_bam_files(df: DataFrame, folder: str, header: str, refs: list[tuple[str, int]]) -> list[str]:
    """Write a table of ``BAM_COLUMNS`` as one file a partition, in the order of its rows, and return the paths.

    Files are written under a name of their own per attempt, and only those of finished tasks are
    returned, so a lost or repeated task leaves nothing that counts. An empty partition gives an empty file.
    """
    system, own, _ = _system(folder)
    system.create_dir(own, recursive=True)

    def run(batches):
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.bam"
        rows = (tuple(r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        write_bam(path, header, refs, rows)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return sorted(r[0] for r in df.select(*BAM_COLUMNS).mapInArrow(run, "path string").collect())


SOURCES = [FastaSource, FastqSource, BamSource]


def register(spark) -> None:
    """Make ``fasta``, ``fastq`` and ``bam`` known to a session."""
    for s in SOURCES:
        spark.dataSource.register(s)
