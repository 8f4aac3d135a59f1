"""BAM and FASTA files as Spark data sources, read in pure Python and emitted as Arrow batches.

A BAM file in block gzip with an index beside it (``x.bam.bai`` or ``x.bai``) is read by several tasks: every offset in the
index is the start of a record, so the file is cut there, about every SPLIT_BYTES. The same index serves region reads.
Without an index, where records start only shows by reading from the start, and the file is one task.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 50_000
SPLIT_BYTES = 32 << 20
#: Fixed values of the index: the bin that holds counts, and the width of its windows as a power of two.
_COUNTS_BIN, _WINDOW_BITS = 37_450, 14
ALIGNMENTS = "rname string, pos int, ref_end int, tlen int, mapq int, flag int, cigar string, qname string, mq int, mc string, cb string, ym string, ord long"
#: The BAM format's CIGAR letters and the widths of its tag types.
_CIGAR = "MIDNSHP=X"
_WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_FORMAT = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def open_file(path: str) -> io.BufferedIOBase:
    """A local file, or any that Arrow's file systems open by URI."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


class BlockGzip(io.RawIOBase):
    """Block gzip as a stream whose places are virtual offsets: a block's place in the file, and 16 bits for that inside it."""

    def __init__(self, raw: io.BufferedIOBase):
        self.raw, self.block, self.next, self.data, self.at = raw, 0, 0, b"", 0

    @staticmethod
    def fits(head: bytes) -> bool:
        return len(head) >= 18 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"BC"

    def _fill(self) -> bool:
        """Moves on to the next block that is not empty."""
        while self.at >= len(self.data):
            self.block = self.next
            self.raw.seek(self.block)
            head = self.raw.read(18)
            if not head:
                return False
            if not self.fits(head):
                raise ValueError("not a block of block gzip")
            size = struct.unpack_from("<H", head, 16)[0] + 1
            body = self.raw.read(size - 18)
            if len(body) != size - 18:
                raise EOFError("the file ends inside a block")
            self.data, self.at, self.next = zlib.decompress(body[:-8], -15), 0, self.block + size
        return True

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0 and self._fill():
            parts.append(self.data[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def tell(self) -> int:
        return self.block << 16 | self.at if self._fill() else self.next << 16

    def seek(self, to: int) -> None:
        self.next, self.data, self.at = to >> 16, b"", 0
        if self._fill():
            self.at = to & 0xFFFF


def opened(raw: io.BufferedIOBase) -> BlockGzip | gzip.GzipFile:
    head = raw.read(18)
    raw.seek(0)
    return BlockGzip(raw) if BlockGzip.fits(head) else gzip.GzipFile(fileobj=raw)


def read_index(path: str) -> list[tuple[list[int], list[int]]] | None:
    """Per contig the starts of its chunks and of its windows, as virtual offsets; None without an index."""
    for at in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        try:
            with open_file(at) as f:
                data = f.read()
        except OSError:
            continue
        if data[:4] != b"BAI\x01":
            raise ValueError(f"{at} is no index")
        place, contigs = 8, []
        for _ in range(struct.unpack_from("<i", data, 4)[0]):
            n_bins = struct.unpack_from("<i", data, place)[0]
            place += 4
            chunks = []
            for _ in range(n_bins):
                number, n = struct.unpack_from("<Ii", data, place)
                if number != _COUNTS_BIN:
                    chunks += struct.unpack_from(f"<{2 * n}Q", data, place + 8)[::2]
                place += 8 + 16 * n
            n = struct.unpack_from("<i", data, place)[0]
            contigs.append((chunks, list(struct.unpack_from(f"<{n}Q", data, place + 4))))
            place += 4 + 8 * n
        return contigs
    return None


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise EOFError("the BAM file ends inside a record")
    return data


def read_header(f) -> tuple[str, list[tuple[str, int]]]:
    if _exactly(f, 4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = _exactly(f, struct.unpack("<i", _exactly(f, 4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", _exactly(f, 4))[0]):
        name = _exactly(f, struct.unpack("<i", _exactly(f, 4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", _exactly(f, 4))[0]))
    return text, contigs


def bam_header(path: str) -> tuple[str, list[tuple[str, int]]]:
    """Header text and (contig, length) in order."""
    with open_file(path) as raw:
        return read_header(opened(raw))


def _tags(data: bytes) -> dict[str, object]:
    at, out = 0, {}
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            out[name] = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            at += 5 + _WIDTH[chr(data[at])] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            out[name] = chr(data[at]) if kind == "A" else struct.unpack_from(_FORMAT[kind], data, at)[0]
            at += _WIDTH[kind]
    return out


def records(f, contigs: list[tuple[str, int]], stop: int | None = None) -> Iterator[tuple]:
    """The alignment records from here on, up to the virtual offset ``stop``, as rows of ALIGNMENTS; ``ord`` orders them as the file does."""
    blocks = isinstance(f, BlockGzip)
    place = f.tell() if blocks else 0
    while (stop is None or place < stop) and (head := f.read(4)):
        data = _exactly(f, struct.unpack("<i", head)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", data)
        at = 32
        qname = data[at : at + l_name - 1].decode()
        at += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", data, at)
        tags = _tags(data[at + 4 * n_cigar + (l_seq + 1) // 2 + l_seq :])
        span = sum(x >> 4 for x in ops if _CIGAR[x & 15] in "MDN=X")
        mq = tags.get("MQ")
        yield (contigs[ref][0] if ref >= 0 else None, pos, pos + span, tlen, mapq, flag, "".join(f"{x >> 4}{_CIGAR[x & 15]}" for x in ops) or "*", qname, None if mq is None else int(mq), tags.get("MC"), tags.get("CB"), tags.get("YM"), place)
        place = f.tell() if blocks else place + 1


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


class _Reader(DataSourceReader):
    """One partition per file: what a file's blocks hold only shows by reading from its start."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]


class _Piece(InputPartition):
    """A part of a file between two virtual offsets, or all of it."""

    def __init__(self, path: str, start: int | None = None, stop: int | None = None):
        super().__init__(path)
        self.start, self.stop = start, stop


class BamReader(_Reader):
    """Options: ``splitBytes``; ``contig`` with ``start`` and ``stop`` for the records that overlap a region."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.contig = options.get("contig")
        self.region = (int(options.get("start", 0)), int(options.get("stop", 1 << 40)))

    def partitions(self) -> list[InputPartition]:
        return [piece for path in self.paths for piece in self._pieces(path)]

    def _pieces(self, path: str) -> list[InputPartition]:
        with open_file(path) as raw:
            f = opened(raw)
            _, contigs = read_header(f)
            first = f.tell() if isinstance(f, BlockGzip) else None
        index = read_index(path) if first is not None else None
        if index is None:
            return [_Piece(path)]
        if self.contig is not None:
            number = [n for n, _ in contigs].index(self.contig)
            chunks, windows = index[number]
            if not chunks:
                return [_Piece(path, first, first)]
            # Empty windows hold 0 or repeat the one before; the first later one that is filled is no further back than needed.
            early = [w for w in windows[: (self.region[0] >> _WINDOW_BITS) + 1] if w]
            return [_Piece(path, max([min(chunks), *early[-1:]]))]
        cuts = [first]
        for at in sorted({v for chunks, windows in index for v in (*chunks, *windows) if v > first}):
            if (at >> 16) - (cuts[-1] >> 16) >= self.split:
                cuts.append(at)
        return [_Piece(path, a, z) for a, z in zip(cuts, [*cuts[1:], None], strict=True)]

    def _wanted(self, rows: Iterator[tuple], sorted_from_here: bool) -> Iterator[tuple]:
        low, high = self.region
        seen = False
        for row in rows:
            if row[0] == self.contig and row[1] < high:
                seen = True
                if row[2] > low:
                    yield row
            elif sorted_from_here and (seen or row[0] == self.contig):
                return

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        ints, text = pa.int32(), pa.string()
        types = [text, ints, ints, ints, ints, ints, text, text, ints, text, text, text, pa.int64()]
        schema = pa.schema([(c.split()[0], t) for c, t in zip(ALIGNMENTS.split(", "), types, strict=True)])
        with open_file(partition.value) as raw:
            f = opened(raw)
            _, contigs = read_header(f)
            if partition.start is not None:
                f.seek(partition.start)
            rows = records(f, contigs, partition.stop)
            yield from _batches(rows if self.contig is None else self._wanted(rows, partition.start is not None), schema)


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: the alignments of BAM files (a comma between several)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ALIGNMENTS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def fasta_blocks(f, block: int) -> Iterator[tuple[str, int, str]]:
    """(contig, block_id, seq): every contig's blocks up to and including index length div block."""
    name, number, held = None, 0, ""
    for line in io.TextIOWrapper(f, "ascii"):
        line = line.strip()
        if line.startswith(">"):
            if name is not None:
                yield name, number, held
            name, number, held = (line[1:].split() or [""])[0], 0, ""
        elif name is not None:
            held += line
            while len(held) >= block:
                yield name, number, held[:block]
                number, held = number + 1, held[block:]
    if name is not None:
        yield name, number, held


class FastaReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.block = int(options.get("block", 1_024))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("contig", pa.string()), ("block_id", pa.int32()), ("seq", pa.string())])
        with open_file(partition.value) as raw:
            f = gzip.GzipFile(fileobj=raw) if partition.value.endswith((".gz", ".bgz")) else raw
            yield from _batches(fasta_blocks(f, self.block), schema)


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``: (contig, block_id, seq) of FASTA files, gzipped or not."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "contig string, block_id int, seq string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.dataSource.register(FastaSource)
