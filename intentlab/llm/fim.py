"""Fill-in-middle transformation by secondary-sort assembly.

A text's units are its lines. Two hashes of the document's id choose the units
at which prefix, middle and suffix meet, two more whether the text is
transformed and in which order the three parts are written. Parts are cut
into pieces of whole units, a unit longer than ``PIECE`` bytes into several, and keyed
by document and position in the output. ``repartitionAndSortWithinPartitions``
brings a document's pieces together in that order, and a task streams them
into an incremental digest. For restoration the pieces of the output are
keyed anew, by the part that the last marker names and their place in it; the second
``repartitionAndSortWithinPartitions`` finds its partitioner in place, so it
sorts again without a shuffle, and the pieces stream into the digest of the
restored text. Both sorts spill to disk, so memory does not follow the length of
a text or the size of a partition; only reading a row holds its text whole.

A document is keyed by its id and the digest of id and text, and by the number of the
input partition: rows repeated whole meet per input partition and are counted, so
a document that holds a third of all rows is spread over the tasks, and
a task that runs again gives its pieces the same keys.

Defined results: a null text is an empty one; an empty text, and one that contains a marker, stays as it
is (``plain``, no part lengths); a null id hashes as an empty text and stays null; repeated rows give
repeated results; an empty table gives none; columns of other names are not
read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import shuffle_partitions

PIECE = 1 << 14
PARTITION = 64 << 20  # bytes of text a sorted partition holds on average, at most


class Options(NamedTuple):
    seed: str = "7"
    rate: int = 100       # per cent of the texts that are transformed
    spm_share: int = 50   # per cent of those that begin with the suffix
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def markers(self) -> dict[str, bytes]:
        return {"p": self.prefix.encode(), "s": self.suffix.encode(), "m": self.middle.encode()}


def draws(doc_id, seed: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def plan(doc_id, data: bytes, options: Options) -> tuple[int, str, int, int]:
    """Units, form, and the bytes at which the middle begins and ends."""
    line_ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    units = len(line_ends) + (bool(data) and data[-1] != 10)
    h1, h2, h3, h4 = draws(doc_id, options.seed)
    if not data or h3 % 100 >= options.rate or any(m in data for m in options.markers().values()):
        return units, "plain", 0, 0
    cut = sorted((h1 % (units + 1), h2 % (units + 1)))
    begin, end = (0 if k == 0 else int(line_ends[k - 1]) if k <= len(line_ends) else len(data) for k in cut)
    return units, "spm" if h4 % 100 < options.spm_share else "psm", begin, end


def cut_pieces(data: bytes, begin: int, end: int) -> Iterator[bytes]:
    """At least one piece; ends are unit ends where a unit ends within ``PIECE`` bytes."""
    while True:
        to = min(end, begin + PIECE)
        if to < end:
            to = data.rfind(b"\n", begin, to) + 1 or to
        yield data[begin:to]
        begin = to
        if begin >= end:
            return


def _pieces(options: Options):
    def run(partition: int, rows: Iterator) -> Iterator[tuple]:
        markers = options.markers()
        for doc_id, text in rows:
            data = (text or "").encode()
            units, form, begin, end = plan(doc_id, data, options)
            lengths = (None, None) if form == "plain" else (len(data[:begin].decode()), len(data[begin:end].decode()))
            digest = hashlib.md5(f"{doc_id}:".encode() + data).digest()
            doc = (doc_id is not None, doc_id if doc_id is not None else 0, digest, partition)
            parts = {"p": (0, begin), "m": (begin, end), "s": (end, len(data))}
            at, head = 0, (units, form, *lengths)
            for part in ("" if form == "plain" else form):
                for i, piece in enumerate(cut_pieces(data, *parts[part])):
                    yield (doc, at), (head if at == 0 else None, markers[part] if i == 0 else b"", piece)
                    at += 1
            if form == "plain":
                for at, piece in enumerate(cut_pieces(data, 0, len(data))):
                    yield (doc, at), (head if at == 0 else None, b"", piece)
    return run


def _place(key: tuple) -> int:
    digest, partition = key[0][2:]
    return zlib.crc32(digest) + partition


def _by_position(pieces: RDD, partitions: int) -> RDD:
    return pieces.repartitionAndSortWithinPartitions(partitions, _place)


def _documents(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Runs of (position, value) of one document; a repeated row's pieces follow each other."""
    pieces = iter(pieces)
    following = next(pieces, None)

    def run(doc):
        nonlocal following
        while following is not None and following[0][0] == doc:
            (_, at), value = following
            copies = 0
            while following is not None and following[0] == (doc, at):
                copies += 1
                following = next(pieces, None)
            yield at, copies, value
    while following is not None:
        doc = following[0][0]
        yield doc, run(doc)


def assembled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = Options()) -> RDD:
    """The output of every document as pieces: ((document, position), (head, marker, bytes)), in order within a partition."""
    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(shuffle_partitions(docs.sparkSession), -(-size // PARTITION))
    return _by_position(rows.rdd.mapPartitionsWithIndex(_pieces(options)), partitions)


def _digested(options: Options):
    """Digests outputs; keys their pieces by place in the text, and puts the digest behind them."""
    def run(pieces: Iterator[tuple]) -> Iterator[tuple]:
        of_marker = {m: "pms".index(part) for part, m in options.markers().items()}
        for doc, parts in _documents(pieces):
            digest, part, rows, head = hashlib.sha256(), 0, 0, None
            for at, copies, (first, marker, piece) in parts:
                if at == 0:
                    head, rows = first, copies
                digest.update(marker)
                digest.update(piece)
                part = of_marker[marker] if marker else part
                yield (doc, (part, at)), piece
            yield (doc, (len(of_marker), 0)), (head, rows, digest.hexdigest())
    return run


def _restored(pieces: Iterator[tuple]) -> Iterator[tuple]:
    doc, digest = None, hashlib.sha256()
    for (of, _), value in pieces:
        if of != doc:
            doc, digest = of, hashlib.sha256()
        if isinstance(value, bytes):
            digest.update(value)
            continue
        head, rows, output = value
        for _ in range(rows):
            yield (doc[1] if doc[0] else None, *head, output, digest.hexdigest())


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = Options()) -> DataFrame:
    """Per row: id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    outputs = assembled(docs, doc_id, text, options)
    keyed = outputs.mapPartitions(_digested(options), preservesPartitioning=True)
    rows = _by_position(keyed, outputs.getNumPartitions()).mapPartitions(_restored)
    return docs.sparkSession.createDataFrame(
        rows, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n long, form string, prefix_chars long, "
              "middle_chars long, output_sha256 string, restored_sha256 string", verifySchema=False)


def outputs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", options: Options = Options()) -> DataFrame:
    """Per row: id, n, form, prefix_chars, middle_chars and the output itself."""
    def join(pieces: Iterator[tuple]) -> Iterator[tuple]:
        for doc, parts in _documents(pieces):
            found = [(copies, *value) for _, copies, value in parts]
            output = b"".join(marker + piece for _, _, marker, piece in found).decode()
            for _ in range(found[0][0]):
                yield (doc[1] if doc[0] else None, *found[0][1], output)
    return docs.sparkSession.createDataFrame(
        assembled(docs, doc_id, text, options).mapPartitions(join),
        f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n long, form string, prefix_chars long, "
        "middle_chars long, output string", verifySchema=False)


def restore(output: str, form: str, options: Options = Options()) -> str:
    """The text of one output."""
    if form == "plain":
        return output
    markers = {part: m.decode() for part, m in options.markers().items()}
    found, rest = {}, output
    for part, after in zip(form, [*form[1:], None]):
        rest = rest[len(markers[part]):]
        found[part], rest = (rest, "") if after is None else (rest[:(i := rest.index(markers[after]))], rest[i:])
    return found["p"] + found["m"] + found["s"]


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS r,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM t),
cuts AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN plain OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
