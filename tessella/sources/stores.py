"""Other stored inputs: archives, transcripts by offset, vector and word tables, golden sets, single events."""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.schema import ARCHIVE

#: Bytes that one reading of a transcript takes from an offset, and from its end; bytes of an event.
TAIL, WHOLE, EVENT = 2 << 20, 64 << 20, 1 << 20


def whole_lines(data: bytes) -> list[bytes]:
    """Lines of gzip members one after the other, up to where one is torn or damaged: what follows the last line end there is dropped."""
    out = bytearray()
    while data:
        member = zlib.decompressobj(31)
        try:
            out += member.decompress(data)
        except zlib.error:
            break
        data = member.unused_data
    return bytes(out).split(b"\n")[:-1]


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive rows of all .jsonl.gz files below path; lines that do not parse and torn ends are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.gz").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames):
        for f in frames:
            rows = [(line.decode("utf-8", "replace"),) for data in f["content"] for line in whole_lines(bytes(data)) if line.strip()]
            yield pd.DataFrame(rows, columns=["line"])

    lines = files.select("content").mapInPandas(run, "line string")
    return lines.select(F.from_json("line", ARCHIVE).alias("x")).where("x.id IS NOT NULL").select("x.*")


def tail(transcripts: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, offset, line_no, line) of what whole lines transcripts(path, content) have from their offsets(path, offset) on.

    A reading takes 2 MiB at most and ends with a line; offset is where the next one begins. A file that is shorter than
    its offset is read from its beginning. A line longer than a reading is read whole.
    """
    joined = transcripts.join(offsets.select(F.col("path").alias("_p"), F.col("offset").alias("_from")), F.col("path") == F.col("_p"), "left")

    def run(frames):
        for f in frames:
            out = []
            for path, content, begin in zip(f["path"], f["content"], f["_from"], strict=True):
                data = bytes(content)
                begin = 0 if pd.isna(begin) or begin > len(data) else int(begin)
                end = data.rfind(b"\n", begin, begin + TAIL) + 1
                if end <= begin:
                    end = data.find(b"\n", begin) + 1
                if end > begin:
                    out += [(path, end, n, line.decode("utf-8", "replace")) for n, line in enumerate(data[begin:end].split(b"\n")[:-1])]
            yield pd.DataFrame(out, columns=["path", "offset", "line_no", "line"])

    return joined.select("path", "content", "_from").mapInPandas(run, "path string, offset long, line_no long, line string")


def endings(transcripts: DataFrame, most: int = WHOLE) -> DataFrame:
    """(path, line_no, line) of the last `most` bytes of transcripts(path, content), without a line that begins before."""
    size = F.octet_length("content")
    cut = F.when(size > most, F.expr(f"substring(content, octet_length(content) - {most} + 1, {most})")).otherwise(F.col("content"))
    text = F.try_validate_utf8(cut.cast("string"))
    lines = F.split(F.coalesce(text, F.decode(cut, "UTF-8")), "\n", -1)
    kept = F.when(size > most, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return transcripts.select("path", F.posexplode(F.filter(kept, lambda x: x != "")).alias("line_no", "line"))


TALK = "type string, isMeta boolean, isCompactSummary boolean, message struct<role: string, content: string>"


def utterances(lines: DataFrame) -> DataFrame:
    """(path, turn, role, text) of transcript lines(path, line_no, line): user and assistant texts, without meta rows and compact summaries.

    A message's content is a string, or a list of blocks of which the texts count.
    """
    raw = F.from_json("line", TALK)
    blocks = F.from_json(raw["message"]["content"], "array<struct<type: string, text: string>>")
    text = F.when(F.startswith(F.ltrim(raw["message"]["content"]), F.lit("[")), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(raw["message"]["content"])
    rows = lines.select("path", F.col("line_no").alias("turn"), raw["message"]["role"].alias("role"), text.alias("text"), F.coalesce(raw["isMeta"], F.lit(False)).alias("meta"), F.coalesce(raw["isCompactSummary"], F.lit(False)).alias("summary"))
    return rows.where(F.col("role").isin("user", "assistant") & ~F.col("meta") & ~F.col("summary") & (F.coalesce("text", F.lit("")) != "")).drop("meta", "summary")


def event(raw: bytes) -> dict:
    """One JSON event; what is longer than 1 MiB, or no object, is an error."""
    if len(raw) > EVENT:
        raise ValueError("the event is longer than 1 MiB")
    data = json.loads(raw)
    if not isinstance(data, dict):
        raise ValueError("the event is no object")
    return data


GOLDEN = "case string, q string, kind string, hard boolean, lang string, expect array<string>, variant string, expect_mode string, not_expect array<string>, type string, tags array<string>, since string"
KINDS, VARIANTS, MODES = ("extract", "multisession", "temporal", "update", "abstain"), ("literal", "paraphrase", "longform"), ("any", "all")


def golden(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """A search golden set as a table; a case must have a question, a known kind, and expected ids unless it is to abstain."""
    rows = []
    for n, c in enumerate(cases):
        kind, mode, variant = c.get("kind", "extract"), c.get("expect_mode", "any"), c.get("variant", "literal")
        if not c.get("q") or kind not in KINDS or mode not in MODES or variant not in VARIANTS:
            raise ValueError(f"case {n} is not well formed")
        if (kind == "abstain") == bool(c.get("expect")):
            raise ValueError(f"case {n} expects ids if and only if it is not to abstain")
        rows.append((str(c.get("id", n)), c["q"], kind, bool(c.get("hard")), c.get("lang"), [*map(str, c.get("expect", []))], variant, mode, [*map(str, c.get("not_expect", []))], c.get("type"), c.get("tags"), c.get("since")))
    return spark.createDataFrame(rows, GOLDEN)


QUALITY = "id string, flag boolean, defects array<string>, rules array<string>, human_only array<string>, allow_rules array<string>"


def quality_golden(spark: SparkSession, data: dict) -> DataFrame:
    """A quality golden set: flagged notes with their defects and rules, and clean ones with the rules that they may fire."""
    rows = [(str(r["id"]), True, r.get("defects", []), r.get("rules", []), r.get("human_only", []), []) for r in data.get("flag", [])]
    rows += [(str(r["id"]), False, [], [], [], r.get("allow_rules", [])) for r in data.get("clean", [])]
    ids = [r[0] for r in rows]
    if len(ids) != len(set(ids)):
        raise ValueError("a note is there twice")
    return spark.createDataFrame(rows, QUALITY)
