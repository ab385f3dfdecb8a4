"""Recording files: headers, 16-bit signals, beat annotations, episodes, reference labels and synonym tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, record string, n_signals int, fs double, n_samples long, signals array<struct<file string, format int, prefix int, gain double, baseline int, unit string, lead string>>"
_SIGNAL = re.compile(r"(?P<file>\S+)\s+(?P<format>\d+)(?:x\d+)?(?::\d+)?(?:\+(?P<prefix>\d+))?(?:\s+(?P<gain>[-\d.eE+]+)(?:\((?P<base>-?\d+)\))?(?:/(?P<unit>\S+))?)?(?P<rest>.*)")


def parse_header(text: str) -> dict:
    """A header: the record line (name, signals, rate, samples), then a line for each signal; # starts a comment."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    name, n, *rest = lines[0].split()
    out = {"record": name.split("/")[0], "n_signals": int(n), "fs": float(rest[0].split("/")[0]) if rest else 250.0, "n_samples": int(rest[1]) if len(rest) > 1 else 0, "signals": []}
    for line in lines[1 : 1 + out["n_signals"]]:
        m = _SIGNAL.match(line)
        rest = m["rest"].split()
        gain, zero = float(m["gain"] or 200) or 200.0, int(rest[1]) if len(rest) > 1 else 0
        out["signals"].append({"file": m["file"], "format": int(m["format"]), "prefix": int(m["prefix"] or 0), "gain": gain, "baseline": int(m["base"]) if m["base"] else zero, "unit": m["unit"] or "mV", "lead": " ".join(rest[5:])})
    return out


def headers(spark: SparkSession, pattern: str) -> DataFrame:
    """One row for each header file."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([{"path": p, **parse_header(bytes(c).decode("utf-8", "replace"))} for p, c in zip(frame["path"], frame["content"], strict=True)], columns=["path", "record", "n_signals", "fs", "n_samples", "signals"])

    return files.mapInPandas(run, HEADER)


def decode16(data: bytes, n_signals: int, gains: list[float], baselines: list[int]) -> np.ndarray:
    """Physical values [signal, sample] of interleaved little-endian 16-bit samples; the least value means missing."""
    raw = np.frombuffer(data, "<i2", len(data) // 2 // n_signals * n_signals).reshape(-1, n_signals)
    out = (raw - np.array(baselines)) / np.array(gains)
    out[raw == -32768] = np.nan
    return out.T


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_range(path: str, first: int, size: int | None) -> bytes:
    """Some bytes of a file, or all from a place on; nothing else of it is read."""
    system, inner = _file_system(path)
    with system.open_input_file(inner) as f:
        return f.read_at(max(0, f.size() - first) if size is None else size, first)


def signals(spark: SparkSession, folder: str, middle_seconds: float | None = None) -> DataFrame:
    """(record, lead, fs, sig) of 16-bit records, one file or several; `middle_seconds` reads a range around the middle.

    Only headers go through the plan: a task reads the bytes of its records from their files, and of a range no others.
    """
    head = headers(spark, f"{folder}/*.hea").where(F.exists("signals", lambda s: s["format"] == 16))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                sig = [s if isinstance(s, dict) else s.asDict() for s in r.signals]
                first, count = 0, r.n_samples or None
                if middle_seconds:
                    count = int(middle_seconds * r.fs)
                    first = max(0, r.n_samples // 2 - count // 2)
                out = []
                for name in dict.fromkeys(s["file"] for s in sig if s["format"] == 16):
                    own = [s for s in sig if s["file"] == name]
                    data = read_range(f"{r.path.rsplit('/', 1)[0]}/{name}", own[0]["prefix"] + 2 * len(own) * first, None if count is None else 2 * len(own) * count)
                    values = decode16(data, len(own), [s["gain"] for s in own], [s["baseline"] for s in own])
                    out += [(r.record, s["lead"], r.fs, v) for s, v in zip(own, values, strict=True)]
                yield pd.DataFrame(out, columns=["record", "lead", "fs", "sig"])

    return head.select("path", "record", "fs", "n_samples", "signals").mapInPandas(run, "record string, lead string, fs double, sig array<double>")


def write_records(rows: DataFrame, folder: str, fs_hz: float, gain: float = 1000.0) -> int:
    """Write (record, lead, sig) as a header and a 16-bit file for each record; gives the number of records.

    A record written again, by a task that ran twice, replaces itself.
    """
    system, inner = _file_system(folder)
    system.create_dir(inner, recursive=True)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("lead")
        record, n = str(frame["record"].iloc[0]), len(frame["sig"].iloc[0])
        raw = np.stack([np.floor(np.asarray(x, float) * gain + 0.5).astype("<i2") for x in frame["sig"]], axis=1)
        lines = [f"{record} {len(frame)} {fs_hz:g} {n}", *(f"{record}.dat 16 {gain:g}(0)/mV 16 0 0 0 0 {lead}" for lead in frame["lead"])]
        system, inner = _file_system(folder)
        for name, data in ((f"{record}.dat", raw.tobytes()), (f"{record}.hea", "\n".join(lines).encode() + b"\n")):
            with system.open_output_stream(f"{inner}/{name}") as f:
                f.write(data)
        return pd.DataFrame({"records": [1]})

    return rows.groupBy("record").applyInPandas(run, "records long").groupBy().sum("records").first()[0] or 0


#: Annotation codes of beats and of rhythm changes, as the format defines them.
CODES = {1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q", 14: "~", 16: "|", 28: "+", 34: "e", 38: "f"}


def parse_annotations(data: bytes) -> list[tuple[int, str, str]]:
    """(sample, symbol, note) of the two-byte format: six bits of code, ten of time since the one before."""
    words, at, sample, out = np.frombuffer(data[: len(data) // 2 * 2], "<u2"), 0, 0, []
    while at < len(words):
        code, low = int(words[at]) >> 10, int(words[at]) & 1023
        at += 1
        if code == 0 and low == 0:
            break
        if code == 59:  # a long interval in the next two words, high one first
            step = (int(words[at]) << 16) | int(words[at + 1])
            sample += step - (1 << 32) if step >= 1 << 31 else step
            at += 2
        elif code == 63:  # a note of so many bytes, padded to words
            text = words[at : at + (low + 1) // 2].tobytes()[:low].decode("latin-1").rstrip("\x00")
            if out:
                out[-1] = (*out[-1][:2], text)
            at += (low + 1) // 2
        elif code in (60, 61, 62):
            continue
        else:
            sample += low
            out.append((sample, CODES.get(code, "?"), ""))
    return out


def annotations(spark: SparkSession, pattern: str) -> DataFrame:
    """(record, sample, symbol, note) of annotation files."""
    files = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("record"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r, *a) for r, c in zip(frame["record"], frame["content"], strict=True) for a in parse_annotations(bytes(c))]
            yield pd.DataFrame(rows, columns=["record", "sample", "symbol", "note"])

    return files.mapInPandas(run, "record string, sample long, symbol string, note string")


def episodes(spark: SparkSession, pattern: str) -> DataFrame:
    """(record, name, onset, offset) of episode files."""
    schema = "ECG_ID string, episodes array<struct<onset long, rhythm_name string, offset long>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return rows.select(F.col("ECG_ID").alias("record"), F.explode("episodes").alias("e")).select("record", F.col("e.rhythm_name").alias("name"), F.col("e.onset").alias("onset"), F.col("e.offset").alias("offset"))


def reference_labels(spark: SparkSession, path: str) -> DataFrame:
    """(record, label) of a reference file without a header."""
    return spark.read.schema("record string, label string").csv(path)


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(name, synonym) of a ragged table: two columns of classes, the name, then any number of synonyms."""
    cells = F.transform(F.split("value", ","), lambda c: F.lower(F.trim(c)))
    rows = spark.read.text(path).select(cells.alias("c")).where(F.size("c") >= 3)
    return rows.select(F.get("c", 2).alias("name"), F.explode(F.slice("c", F.lit(3), F.size("c"))).alias("synonym")).where("synonym <> ''").distinct()


def record_index(spark: SparkSession, path: str, fraction: float | None = None, seed: int = 12345) -> DataFrame:
    """(path, record) of an index with one relative path a line, or a part of it by hash."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("path"), F.element_at(F.split(F.trim("value"), "/"), -1).alias("record"))
    return rows if fraction is None else rows.where(F.pmod(F.xxhash64(F.lit(seed), "path"), F.lit(1_000_000)) < int(fraction * 1_000_000))
