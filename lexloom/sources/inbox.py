"""Files as tables: the inbox with its formats, recorded feed pages, and answers of models kept by content."""

from __future__ import annotations

import html
import io
import json
import re
import subprocess
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.nested import parse
from lexloom.runtime import Scratch

FORMATS = ("docx", "html", "htm", "txt", "md")
KNOWN = (*FORMATS, "pdf", "doc")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLOCKS = "kind string, text string, level int"


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, sector, file_type, content): files of the known formats below a folder, hidden ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(re.sub(r"^[a-z]+:/+", "/", folder).rstrip("/")) + "/", "")
    name = F.element_at(F.split("path", "/"), -1)
    parent = F.when(F.contains(inside, F.lit("/")), F.element_at(F.split(inside, "/"), -2))
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.select("path", name.alias("name"), F.coalesce(T.slugify(parent), F.lit("general")).alias("sector"), kind.alias("file_type"), "content").where(F.col("file_type").isin(*KNOWN) & ~F.startswith("name", F.lit(".")))


def _docx(content: bytes) -> list[tuple[str, str, int]]:
    """Blocks of a word-processing file in the order of its body; table rows as one paragraph each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, str, int]] = []
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            words = " ".join(text(node).split())
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"heading\s*(\d+)|^(title)$", style.get(f"{_W}val", "").lower()) if style is not None else None
            if words:
                out.append(("heading", words, int(level.group(1) or 1)) if level else ("paragraph", words, 0))
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = list(dict.fromkeys(c for c in (" ".join(text(x).split()) for x in row.iter(f"{_W}tc")) if c))
                if len(cells) >= 2 and len(cells[0]) <= 60:
                    out += [("heading", cells[0], 0), ("paragraph", " ".join(cells[1:]), 0)]
                elif cells:
                    out.append(("paragraph", " | ".join(cells), 0))
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """(path, title, file_type, parse_error, blocks): never fails; a file that can't be read has a parse_error and no blocks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["file_type"], batch["content"]):
                blocks: list = []
                error = None
                try:
                    if kind == "docx":
                        blocks = _docx(content)
                    elif kind in ("html", "htm"):
                        plain = re.sub(r"(?i)</?(?:p|h[1-6]|li|div|br|tr)\b[^>]*>", "\n", content.decode("utf-8", "replace"))
                        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in plain.split("\n")]
                        blocks = [("paragraph", x, 0) for x in lines if x]
                    elif kind in ("txt", "md"):
                        blocks = [("paragraph", " ".join(x.split()), 0) for x in content.decode("utf-8", "replace").split("\n\n") if x.strip()]
                    else:
                        error = f"no reader for .{kind} files"
                    if not error and not blocks:
                        error = "no text found"
                except Exception as e:  # noqa: BLE001
                    blocks, error = [], f"{type(e).__name__}: {e}"[:300]
                out.append((path, kind, error, [{"kind": k, "text": t, "level": n} for k, t, n in blocks]))
            yield pd.DataFrame(out, columns=["path", "file_type", "parse_error", "blocks"])

    parsed = files.select("path", "file_type", "content").mapInPandas(read, f"path string, file_type string, parse_error string, blocks array<struct<{_BLOCKS.replace(' string', ':string').replace(' int', ':int')}>>")
    return parsed.select("path", T.file_title(F.col("path")).alias("title"), "file_type", "parse_error", "blocks")


_HIT = "title string, subtitle string, reportType string, reportId string, sittingDate string, maxResult string, memberName string, mpNames string"


def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of recorded search pages; fields that are missing are null."""
    return spark.read.json(folder, schema=_HIT, multiLine=True)


def sitting_dates(hits: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """(sitting_date): distinct dates within a range, the newest first."""
    days = hits.select(T.iso_date(F.col("sittingDate")).alias("sitting_date")).where("sitting_date is not null")
    days = days.where(F.col("sitting_date") >= first) if first else days
    days = days.where(F.col("sitting_date") <= last) if last else days
    return days.distinct().orderBy(F.desc("sitting_date"))


def cache_key(**parts: Column) -> Column:
    """What an answer depends on, as one key: the same parts give the same key in any order."""
    return F.sha2(F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in sorted(parts.items())])), 256)


#: Callables a task can ask, by name: text in, JSON text out.
PROVIDERS: dict[str, Callable[[str], str]] = {}


def provider(name: str) -> Callable[[str], str]:
    if name not in PROVIDERS:
        raise ValueError(f"no such provider: {name}")
    return PROVIDERS[name]


class Offline(RuntimeError):
    """A provider was asked while nothing may be."""


def command_provider(command: list[str], timeout: float = 600, offline: bool = False) -> Callable[[str], str]:
    """Asks a program: the prompt on its standard input, the answer on its standard output."""

    def call(prompt: str) -> str:
        if offline:
            raise Offline(command[0])
        done = subprocess.run(command, input=prompt, capture_output=True, text=True, timeout=timeout, check=False)
        if done.returncode:
            raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-300:]}")
        return done.stdout

    return call


def http_provider(url: str, model: str, timeout: float = 600, offline: bool = False) -> Callable[[str], str]:
    """Asks a server that takes {model, messages} as JSON and answers with choices, or with a response or content field."""

    def call(prompt: str) -> str:
        if offline:
            raise Offline(url)
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as answer:  # noqa: S310
            held = json.loads(answer.read().decode("utf-8"))
        choices = held.get("choices")
        return choices[0]["message"]["content"] if choices else held.get("response") or held["content"]

    return call


def ask(requests: DataFrame, cached: DataFrame, name: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(answers, new): answers (id, key, answer) of requests (id, prompt), and the rows to add to the cache (key, answer).

    Known answers come from ``cached``; of equal prompts one is asked; a failure or an answer that is no JSON is null
    and not kept, so that it is asked again the next time. New answers are written to scratch once, so nothing is asked twice
    and the answers are those that go to the cache.
    """
    call = provider(name)
    keyed = requests.withColumn("key", cache_key(provider=F.lit(name), model=F.lit(model), prompt=F.col("prompt")))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, prompt in zip(batch["key"], batch["prompt"]):
                try:
                    found = re.search(r"\{.*\}", call(prompt), re.S)
                    good = found and parse(found.group())[0]
                    out.append((key, json.dumps(json.loads(found.group()), sort_keys=True) if good else None))
                except Exception:  # noqa: BLE001
                    out.append((key, None))
            yield pd.DataFrame(out, columns=["key", "answer"])

    missing = keyed.join(cached.select("key"), "key", "left_anti").groupBy("key").agg(F.first("prompt").alias("prompt"))
    new = Scratch(requests.sparkSession, "answers").put(missing.mapInPandas(answer, "key string, answer string").where("answer is not null"), "new")
    return keyed.join(cached.unionByName(new), "key", "left").select("id", "key", "answer"), new
