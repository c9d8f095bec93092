"""Mail and zipped logs as data sources whose splits are planned: an mbox file in ranges of bytes, small files many to a task, an
archive's members dealt out. Reading goes through Arrow's file systems, so paths are those of any storage that it knows.

    mbox.read_mail(spark, "hdfs:///mail", schema="sender string, subject string").where("subject like 'Re:%'")

Only what the schema names is parsed: without `body` a message is kept to the end of its header. The option `files`, a pattern of
paths, is met when splits are planned. `split` is the least that a task reads: a task of Python costs a tenth of a second however
little it reads, so where there is more than A_CORE splits a core, splits are as much larger, up to SPLIT."""

from __future__ import annotations

import email.errors
import email.message
import email.parser
import fnmatch
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mailquarry.functions import udf as U

MAIL = "file string, at long, sender string, receivers string, subject string, date string, message_id string, body string"
ZIPPED = "file string, member string, content string"
HEADERS = {"sender": "From", "receivers": "To", "subject": "Subject", "date": "Date", "message_id": "Message-ID"}
SPLIT = 64 << 20
#: Ranges that each core gets, if there is that much to read.
A_CORE = 4
#: What opening a file costs, in bytes read meanwhile: a task takes at most SPLIT / OPENING files.
OPENING = 1 << 16
_BROKEN = (ValueError, TypeError, AttributeError, LookupError, email.errors.MessageError)
_ESCAPED = re.compile(rb"^>(>*From )", re.M)
_BLANK = re.compile(rb"(?:\A|\n)\r?\n")
_PARSER = email.parser.BytesParser(policy=U.MAIL_POLICY)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(file, bytes) below a path or of one file, in order; hidden ones are left out."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
    shown = [f for f in found if not any(x[:1] in ("_", ".") for x in f.path[len(root) :].split("/"))]
    return sorted((f.path, f.size) for f in shown)


def _opened(path: str, file: str) -> io.BufferedReader:
    return io.BufferedReader(_system(path)[0].open_input_file(file), 1 << 20)


@dataclass
class Pieces(InputPartition):
    """Pieces of files: (file, from, to), of an archive (file, number, of how many)."""

    pieces: list[tuple[str, int, int]]


def packed(files: list[tuple[str, int]], split: int) -> Iterator[Pieces]:
    """Whole files, many to a task."""
    held, size = [], 0
    for file, n in files:
        if held and size + n + OPENING > split:
            yield Pieces(held)
            held, size = [], 0
        held.append((file, 0, n))
        size += n + OPENING
    if held:
        yield Pieces(held)


def messages(f: io.BufferedReader, start: int, end: int, body: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the messages whose "From " line begins in [start, end); one that goes on behind the end is read whole.
    Lines of a body that begin with From, and any > before it, have one more > in the file, which is taken off."""
    at = start
    f.seek(max(0, start - 1))
    if start:
        at = start - 1 + len(f.readline())
    begun, held, head = -1, [], True
    while line := f.readline():
        if line.startswith(b"From "):
            if begun >= 0:
                yield begun, b"".join(held)
            if at >= end:
                return
            begun, held, head = at, [], True
        elif begun >= 0:
            if head or body:
                held.append(line)
            head = head and bool(line.strip(b"\r\n"))
        elif at >= end:
            return
        at += len(line)
    if begun >= 0:
        yield begun, b"".join(held)


def _header(m: email.message.Message, name: str) -> str | None:
    try:
        value = m.get(name)
    except _BROKEN:  # a header that the parser cannot read stays as it is written
        value = next((v for k, v in m.raw_items() if k.lower() == name.lower()), None)
    return None if value is None else str(value).encode("utf-8", "replace").decode()


def _message(head: bytes, rest: bytes) -> email.message.Message:
    """The message of a header with the blank line behind it and of a body. Only a body of parts is parsed, or one that the header
    is not clearly set off from; any other is taken as it is, as the parser would after looking at each of its lines."""
    m = _PARSER.parsebytes(head, headersonly=True)
    if m.defects or m.get_payload() or m.get_content_maintype() in ("multipart", "message"):
        return _PARSER.parsebytes(head + rest)
    m.set_payload(rest.decode("ascii", "surrogateescape"))
    return m


def fields(raw: bytes, names: list[str], file: str, at: int, mbox: bool) -> tuple:
    """What is asked of a message; a header that it does not have is null, a body without plain text is empty."""
    body = "body" in names
    blank = _BLANK.search(raw)
    end = blank.end() if blank else len(raw)
    rest = raw[end:] if body else b""
    if mbox and body:
        rest = _ESCAPED.sub(rb"\1", rest).removesuffix(b"\n")  # the line end before the next From line
    m = _message(raw[:end], rest)
    known = {"file": file, "at": at}
    return tuple(known[n] if n in known else U.plain_text(m) if n == "body" else _header(m, HEADERS[n]) for n in names)


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.path = options["path"]
        self.least = int(options.get("split", SPLIT))
        self.tasks = int(options.get("tasks", 0))
        self.only = options.get("files", "*")

    def files(self) -> tuple[list[tuple[str, int]], int]:
        """Files and the bytes of a split."""
        files = [x for x in _files(self.path) if fnmatch.fnmatch(x[0], self.only)]
        even = -(-sum(n for _, n in files) // self.tasks) if self.tasks else 0
        return files, max(self.least, min(SPLIT, even))


class MailReader(_Reader):
    def __init__(self, schema, options):
        super().__init__(schema, options)
        self.mbox = options.get("layout", "mbox") == "mbox"
        if bad := set(self.names) - {"file", "at", "body", *HEADERS}:
            raise ValueError(f"no such fields of mail: {sorted(bad)}")

    def partitions(self):
        """Large mbox files in ranges, small ones and single mails many to a task."""
        files, split = self.files()
        large = [x for x in files if self.mbox and x[1] > split]
        cut = [Pieces([(file, a, min(a + split, n))]) for file, n in large for a in range(0, n, split)]
        return cut + list(packed([x for x in files if not (self.mbox and x[1] > split)], split)) or [Pieces([])]

    def read(self, partition):
        body = "body" in self.names
        for file, start, end in partition.pieces:
            with _opened(self.path, file) as f:
                if self.mbox:
                    for at, raw in messages(f, start, end, body):
                        yield fields(raw, self.names, file, at, True)
                else:
                    yield fields(f.read(), self.names, file, 0, False)


class MailSource(DataSource):
    @classmethod
    def name(cls):
        return "mail"

    def schema(self):
        return MAIL

    def reader(self, schema):
        return MailReader(schema, self.options)


class ZippedReader(_Reader):
    def __init__(self, schema, options):
        super().__init__(schema, options)
        self.members = options.get("members", "*")

    def partitions(self):
        """Small archives many to a task; the members of a large one are dealt to as many tasks as it has splits."""
        files, split = self.files()
        large = [x for x in files if x[1] > split]
        dealt = [Pieces([(file, k, of)]) for file, n in large for of in [-(-n // split)] for k in range(of)]
        small = [Pieces([(file, 0, 1) for file, _, _ in p.pieces]) for p in packed([x for x in files if x[1] <= split], split)]
        return dealt + small or [Pieces([])]

    def read(self, partition):
        for file, k, of in partition.pieces:
            with _opened(self.path, file) as f, zipfile.ZipFile(f) as z:
                wanted = sorted(n for n in z.namelist() if not n.endswith("/") and fnmatch.fnmatch(n, self.members))
                for name in wanted[k::of]:
                    value = {"file": file, "member": name}
                    yield tuple(value[n] if n in value else z.read(name).decode("utf-8", "replace") for n in self.names)


class ZippedSource(DataSource):
    @classmethod
    def name(cls):
        return "zipped"

    def schema(self):
        return ZIPPED

    def reader(self, schema):
        return ZippedReader(schema, self.options)


def _planned(spark: SparkSession, source: str, schema: str, split: int):
    return spark.read.format(source).schema(schema).option("split", split).option("tasks", A_CORE * spark.sparkContext.defaultParallelism)


def read_mail(spark: SparkSession, path: str, layout: str = "mbox", schema: str = MAIL, split: int = SPLIT, files: str = "*") -> DataFrame:
    """Mail of mbox files, or of folders with one mail a file (layout `files`), as those columns of MAIL that the schema has."""
    spark.dataSource.register(MailSource)
    return _planned(spark, "mail", schema, split).option("layout", layout).option("files", files).load(path)


def read_zipped(spark: SparkSession, path: str, members: str = "*", schema: str = ZIPPED, split: int = SPLIT) -> DataFrame:
    """Members of zip archives whose names fit a pattern, as those columns of ZIPPED that the schema has."""
    spark.dataSource.register(ZippedSource)
    return _planned(spark, "zipped", schema, split).option("members", members).load(path)
