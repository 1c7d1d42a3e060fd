"""Semi-structured log lines into fields, by longest-common-subsequence template mining.

1. ``mine_layouts``: every line becomes a sequence of atoms (timestamp by form, level word, key, punctuation, number, word, quoted text;
   key-value lines become their sorted keys). Each partition clusters its sequences by LCS: a sequence joins the template with the same timestamp form
   whose LCS covers at least TAU of the shorter one, and the template shrinks to the LCS, with a gap where atoms dropped out.
   Partition templates are merged by the same rule in a tree. What remains constant is the layout; gaps and words are its slots.
2. ``classify``: slots get their type (timestamp, level, component, message) from what they hold and where they stand.
3. ``parse_lines``: each layout becomes one anchored pattern; a line that fits one is a header line and yields its fields.
4. ``log_entries``: lines of a file up to the next header are one entry.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from .ordered import carry_forward

#: Share of the shorter sequence that a common subsequence must cover for two to be of one layout.
TAU = 0.75

# Level words and their canonical names; single letters where a severity is glued to the timestamp.
LEVELS = {
    "trace": "TRACE", "debug": "DEBUG", "dbg": "DEBUG", "info": "INFO", "notice": "INFO", "warn": "WARN", "warning": "WARN",
    "error": "ERROR", "err": "ERROR", "fatal": "FATAL", "crit": "FATAL", "critical": "FATAL",
}
LETTERS = {"T": "TRACE", "D": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "FATAL", "C": "FATAL"}

MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
CLOCK = r"\d\d:\d\d:\d\d(?:[.,]\d{1,9})?"
ZONE = r"(?:\s?(?:Z\b|[+-]\d\d:?\d\d\b))?"
TIMESTAMP = rf"(?:\d{{4}}[-/.]\d\d[-/.]\d\d[T ]{CLOCK}{ZONE}|\d\d/{MONTH}/\d{{4}}:{CLOCK}{ZONE}|\d\d[-/.]\d\d[-/.]\d{{4}} {CLOCK}{ZONE}|(?:[A-Z][a-z]{{2}} )?{MONTH} [ \d]\d {CLOCK}(?: \d{{4}})?|\d{{4}} {CLOCK}|{CLOCK}{ZONE}|\d{{10}}(?:\.\d{{1,9}}|\d{{3}}|\d{{6}}|\d{{9}})?(?![\w.]))"
ATOM = re.compile(
    rf"(?P<sev>(?<!\w)[A-Z](?=\d{{4}} {CLOCK}))|(?P<ts>(?<![\w.]){TIMESTAMP}|(?<=\b[A-Z])\d{{4}} {CLOCK})|(?P<q>\"(?:[^\"\\]|\\.)*\")|(?P<key>[A-Za-z_@][\w.@-]*)(?==)|(?P<w>[\w./@+-]+)|(?P<p>[^\w\s])"
)
ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
PAIR = re.compile(r"([A-Za-z_@][\w.@-]*)=(\"(?:[^\"\\]|\\.)*\"|\S*)")
KV_LINE = re.compile(r"(?:[A-Za-z_@][\w.@-]*=(?:\"(?:[^\"\\]|\\.)*\"|[^\s\"]*)(?:\s+|$))+")
TS_ONLY = re.compile(TIMESTAMP)
UNESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def clean(line: str) -> str:
    """Without colour codes and trailing line ends; leading blanks stay, they tell continuations from headers."""
    return ANSI.sub("", line).rstrip("\r\n") if "\x1b" in line else line.rstrip("\r\n")


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), text) if "\\" in text else text


def ts_form(text: str) -> str:
    return re.sub(r"\d", "0", re.sub("[A-Z][a-z]{2}", "Aaa", re.sub(r" \d(?=\d? )|  (?=\d )", " 0", text)))


def pairs_of(line: str) -> tuple[str, dict] | None:
    """A line that is wholly key-value pairs or one flat JSON object, as (kind, pairs); None for any other line."""
    if line[:1] == "{":
        try:
            value = json.loads(line)
        except ValueError:
            return None
        if isinstance(value, dict) and value:
            return "json", value
        return None
    if "=" in line and KV_LINE.fullmatch(line):
        return "kv", {k: unescape(v[1:-1]) if v[:1] == '"' and len(v) > 1 else v for k, v in PAIR.findall(line)}
    return None


def value_atom(value) -> str:
    if not isinstance(value, str):
        return "n"
    if TS_ONLY.fullmatch(value):
        return f"ts:{ts_form(value)}"
    if value.lower() in LEVELS:
        return "lvl"
    if re.fullmatch(r"[\d.]+", value):
        return "n"
    return "text" if re.search(r"\s", value) else "w"


def atoms_of(line: str) -> tuple[str, ...]:
    """The line as atoms. The first is "kv", "json" or "line"; a leading blank gives "indent"."""
    found = pairs_of(line)
    if found:
        kind, pairs = found
        return (kind, *sorted(f"@{k}" for k in pairs))
    out = ["line"]
    if line[:1].isspace():
        out.append("indent")
    for m in ATOM.finditer(line):
        kind, text = m.lastgroup, m[0]
        if kind == "ts":
            out.append(f"ts:{ts_form(text)}")
        elif kind == "w":
            low = text.lower()
            out.append("lvl" if low in LEVELS else "n" if text.isdigit() else "w")
        elif kind == "key":
            out.append(f"key:{text}")
        elif kind == "p":
            out.append(text)
        else:
            out.append(kind)
    return tuple(out)


def block_of(atoms: tuple[str, ...]) -> str:
    """What a template is compared within: its kind and its first timestamp form ("" if there is none)."""
    return f"{atoms[0]}|{next((a for a in atoms if a.startswith('ts:')), '')}"


def lcs(a: tuple[str, ...], b: tuple[str, ...]) -> list[str]:
    """A longest common subsequence, the one that matches as early as possible; "*" where either side skipped atoms."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] and a[i] != "*" else max(below[j], row[j + 1])
    out: list[str] = []
    i = j = 0
    gap = False
    while i < n and j < m:
        if a[i] == b[j] and a[i] != "*" and best[i][j] == best[i + 1][j + 1] + 1:
            if gap:
                out.append("*")
            out.append(a[i])
            gap = False
            i, j = i + 1, j + 1
        else:
            gap = True
            if best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    if gap or i < n or j < m:
        out.append("*")
    return out


def solid(atoms: Iterable[str]) -> int:
    return sum(a != "*" for a in atoms)


def _has_layout(atoms: Iterable[str]) -> bool:
    atoms = list(atoms)
    return atoms[0] == "line" and "indent" not in atoms[:2] and _positional(atoms[1:]) is not None


def merge_templates(weighted: list[tuple[tuple[str, ...], int]], tau: float = TAU) -> dict[tuple[str, ...], int]:
    """Cluster sequences of one block by LCS until no two templates can be joined. The order of merging is fixed by weight.

    A merge that would leave the heavier template without a layout is not made: one stray line must not cost a layout its headers.
    """
    templates: list[list] = []
    for atoms, n in sorted(weighted, key=lambda x: (-x[1], len(x[0]), x[0])):
        for t in templates:
            common = lcs(t[0], atoms)
            if solid(common) >= tau * min(solid(t[0]), solid(atoms)) and (_has_layout(common) or not _has_layout(t[0])):
                t[0], t[1] = tuple(common), t[1] + n
                break
        else:
            templates.append([atoms, n])
    merged: dict[tuple[str, ...], int] = {}
    for atoms, n in templates:
        merged[atoms] = merged.get(atoms, 0) + n
    return merged if len(merged) in (1, len(weighted)) else merge_templates(list(merged.items()), tau)


def _emit(blocks: dict[str, dict]) -> pd.DataFrame:
    rows = [(b, json.dumps(list(a)), n) for b, ts in blocks.items() for a, n in ts.items()]
    return pd.DataFrame(rows, columns=["block", "template", "n"])


def _mine_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Templates of one partition. Sequences are clustered batch by batch, so memory holds templates, not lines."""
    kept: dict[str, dict] = {}
    for frame in frames:
        seen = Counter(atoms_of(clean(x)) for x in frame.iloc[:, 0].tolist() if x)
        by: dict[str, Counter] = {}
        for atoms, n in seen.items():
            if any(a.startswith("ts:") for a in atoms) or atoms[0] != "line":  # a layout without time has no header to find
                by.setdefault(block_of(atoms), Counter())[atoms] += n
        for block, counts in by.items():
            for atoms, n in kept.get(block, {}).items():
                counts[atoms] += n
            kept[block] = merge_templates(list(counts.items()))
    yield _emit(kept)


def _merge_group(frame: pd.DataFrame) -> pd.DataFrame:
    block = frame["block"].iloc[0]
    merged = merge_templates([(tuple(json.loads(t)), int(n)) for t, n in zip(frame["template"], frame["n"])])
    out = _emit({block: merged})
    out["part"] = int(frame["part"].iloc[0])
    return out[["block", "template", "n", "part"]]


def mine_layouts(lines: DataFrame, column: str, fan: int = 64) -> list[dict]:
    """The layouts of all lines: [{kind, n, pattern or keys}], the most frequent first. Templates of partitions are merged ``fan`` at a time, then in one last group a timestamp form.

    Templates are classified and equal layouts added up before they come to the driver, which sees one row a layout; templates of continuations stay behind.
    """
    parts = lines.select(column).mapInPandas(_mine_partition, "block string, template string, n long")
    parts = parts.withColumn("part", (F.spark_partition_id() / fan).cast("int"))
    schema = "block string, template string, n long, part int"
    level = parts.groupBy("block", "part").applyInPandas(_merge_group, schema)
    level = level.withColumn("part", F.lit(0)).groupBy("block", "part").applyInPandas(_merge_group, schema)
    told = level.mapInPandas(_classify_frames, "layout string, n long").groupBy("layout").agg(F.sum("n").alias("n"))
    found = [{**json.loads(r["layout"]), "n": r["n"]} for r in told.collect()]
    return sorted(found, key=lambda x: (-x["n"], x.get("pattern") or "", x.get("keys") or []))


def _classify_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = classify([{"template": json.loads(t), "n": int(n)} for t, n in zip(frame["template"], frame["n"])])
        rows = [(json.dumps({k: v for k, v in x.items() if k in ("kind", "pattern", "keys")}, sort_keys=True), x["n"]) for x in found]
        yield pd.DataFrame(rows, columns=["layout", "n"]).astype({"n": "int64"})


def classify(found: list[dict]) -> list[dict]:
    """Layouts whose slots include a timestamp before any indent and a message, as {kind, pattern or keys}. Others are continuations."""
    out = []
    for t in found:
        atoms = t["template"]
        if atoms[0] == "line" and "indent" not in atoms[:2]:
            layout = _positional(atoms[1:])
            if layout:
                out.append({"kind": "line", "n": t["n"], **layout})
        elif atoms[0] in ("kv", "json"):
            out.append({"kind": atoms[0], "n": t["n"], "keys": [a[1:] for a in atoms[1:] if a[0] == "@"]})
    return out


LEVEL_PATTERN = "|".join(sorted(LEVELS, key=len, reverse=True))
SLOT = {"w": r"[^\s\[\]|:=,\"]+", "n": r"\d+", "q": r'"(?:[^"\\]|\\.)*"', "sev": "[A-Z]"}


def _form_pattern(form: str) -> str:
    out = re.escape(form).replace("Aaa\\ 00", f"{MONTH} [ \\d]\\d").replace("Aaa\\ 0", f"{MONTH} [ \\d]\\d").replace("Aaa", "[A-Z][a-z]{2}")
    return re.sub("0", r"\\d", out)


def _positional(atoms: list[str]) -> dict | None:
    """A pattern for a layout told by position: the message is the last run of free text, the component the word slot nearest before it."""
    stamp = next((i for i, a in enumerate(atoms) if a.startswith("ts:")), None)
    if stamp is None:
        return None
    free = {"*", "w", "n", "q"}
    runs, i = [], 0
    while i < len(atoms):
        if atoms[i] in free:
            j = i
            while j < len(atoms) and atoms[j] in free:
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    after = [r for r in runs if r[0] > stamp and (r[1] - r[0] > 1 or "*" in atoms[r[0] : r[1]])]
    if not after:
        return None
    begin, end = after[-1]
    words = [k for k in range(begin) if atoms[k] == "w"]
    level = next((k for k, a in enumerate(atoms) if a == "lvl"), None)
    severity = next((k for k, a in enumerate(atoms) if a == "sev"), None)
    if not words:
        return None
    component = words[-1]
    parts = []
    for k, a in enumerate(atoms[:begin]):
        if k == stamp:
            parts.append(f"(?P<ts>{_form_pattern(a[3:])})")
        elif k == component:
            parts.append(f"(?P<component>{SLOT['w']})")
        elif k == level:
            parts.append(f"(?P<level>(?i:{LEVEL_PATTERN}))")
        elif k == severity:
            parts.append(f"(?P<level>{SLOT['sev']})")
        elif a == "*":
            parts.append(r"(?:\S+\s+)*?")
        elif a.startswith("ts:"):
            parts.append(_form_pattern(a[3:]))
        elif a == "lvl":
            parts.append(f"(?i:{LEVEL_PATTERN})")
        elif a.startswith("key:"):
            parts.append(re.escape(a[4:]))
        else:
            parts.append(SLOT.get(a) or re.escape(a))
    tail = []
    for k in range(end, len(atoms)):
        a = atoms[k]
        if k == level:
            tail.append(f"(?P<level>(?i:{LEVEL_PATTERN}))")
        elif a.startswith("key:"):
            tail.append(re.escape(a[4:]))
        elif a.startswith("ts:"):
            tail.append(_form_pattern(a[3:]))
        else:
            tail.append(SLOT.get(a) or re.escape(a))
    glue = []
    for k, p in enumerate(parts):
        glue.append(p)
        if k + 1 < len(parts) and not (atoms[k] == "sev"):
            wordy = atoms[k] in ("w", "n", "lvl") and atoms[k + 1] in ("w", "n", "lvl")
            glue.append(r"\s+" if wordy or (atoms[k].startswith("ts:") and atoms[k + 1] in ("w", "n", "lvl")) else r"\s*")
    last = atoms[begin - 1] if begin else ""
    head = "".join(glue) + (r"(?:\s+|$)" if last in ("w", "n", "lvl") or last.startswith("ts:") else r"\s*")
    return {"pattern": head + r"(?P<message>.*?)\s*" + r"\s*".join(tail) + r"\s*", "atoms": atoms}


class Parser:
    """Applies classified layouts to lines; picklable, compiled on first use in each worker."""

    def __init__(self, layouts: list[dict]):
        self.layouts = layouts
        self._compiled = None

    def __getstate__(self):
        return {"layouts": self.layouts, "_compiled": None}

    def _compile(self):
        lines = [re.compile(x["pattern"], re.S) for x in self.layouts if x["kind"] == "line"]
        keys = {k: [frozenset(x["keys"]) for x in self.layouts if x["kind"] == k] for k in ("kv", "json")}
        self._compiled = (lines, keys)
        return self._compiled

    def parse(self, raw: str) -> tuple[str, str, str, str] | None:
        """(ts_text, level, component, message) of a header line, else None."""
        patterns, keys = self._compiled or self._compile()
        line = clean(raw)
        found = pairs_of(line) if line[:1] == "{" or "=" in line else None
        if found and any(k <= found[1].keys() for k in keys[found[0]]):
            fields = self._pairs(found[1])
            if fields:
                return fields
        if line[:1].isspace():
            return None
        for p in patterns:  # in the order of the layouts' weight, whatever was seen before
            m = p.fullmatch(line)
            if m:
                g = m.groupdict()
                level = g.get("level") or ""
                level = LETTERS.get(level, LEVELS.get(level.lower(), "")) if level else ""
                return g["ts"], level, g["component"], g["message"].strip()
        return None

    @staticmethod
    def _pairs(pairs: dict) -> tuple[str, str, str, str] | None:
        """Roles of the pairs by the type of what they hold: the time, the level, then text for the message and a word for the component."""
        ts = level = None
        rest = []
        for k, v in pairs.items():
            kind = value_atom(v)
            if ts is None and kind.startswith("ts:"):
                ts = v
            elif level is None and kind == "lvl" and ROLE.get(k.lower(), "level") == "level":
                level = LEVELS[v.lower()]
            elif isinstance(v, str):
                rest.append((k, v, kind))
        if ts is None or not rest:
            return None
        message = next((x for x in rest if ROLE.get(x[0].lower()) == "message"), None) or max(rest, key=lambda x: (x[2] == "text", len(x[1])))
        others = [x for x in rest if x is not message]
        component = next((x for x in others if ROLE.get(x[0].lower()) == "component"), None) or next((x for x in others if x[2] == "w"), None)
        return ts, level or "", component[1] if component else "", message[1].strip()


# Usual names of keys, used where the types of the values leave a choice.
ROLE = {"msg": "message", "message": "message", "component": "component", "logger": "component", "level": "level", "lvl": "level", "severity": "level"}

FIELDS = ("ts_text", "log_level", "component", "message")


def parse_lines(df: DataFrame, column: str, layouts: list[dict]) -> DataFrame:
    """Add ts_text, log_level, component and message; all four are null where the line is no header (or null)."""
    parser = Parser(layouts)
    schema = StructType(list(df.schema.fields))
    for name in FIELDS:
        schema = schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            got = [parser.parse(x) if x else None for x in batch.column(at).to_pylist()]
            fields = [pa.array([g[i] if g else None for g in got], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fields], [*batch.schema.names, *FIELDS])

    return df.mapInArrow(run, schema)


def layouts_of(*sources: tuple[DataFrame, str]) -> list[dict]:
    """Mine and classify the layouts over all lines of all sources."""
    lines = None
    for df, column in sources:
        one = df.select(F.col(column).alias("line")).where(F.col(column).isNotNull())
        lines = one if lines is None else lines.unionByName(one)
    return mine_layouts(lines, "line")


def log_entries(lines: DataFrame, layouts: list[dict], file: str = "file_name", pos: str = "line_no", line_id: str = "line_id", text: str = "log_vector") -> DataFrame:
    """Entries of files: (line_id of the first line, n_lines, ts_text, log_level, component, message).

    A header line begins an entry; later lines of its file belong to it up to the next header; lines before the first header belong to none. A null line
    is a continuation. Each line_id counts once. A file of any length spreads over range partitions that are chained by one row each; an entry
    of any length is counted by partial sums.
    """
    rows = lines.select(F.col(line_id).alias("line_id"), F.col(file).alias("file_name"), F.col(pos).alias("line_no"), F.col(text).alias("line")).dropDuplicates(["line_id"])
    parsed = cut(parse_lines(rows, "line", layouts).drop("line"))
    parsed = parsed.withColumn("__head", F.when(F.col("message").isNotNull(), F.col("line_id")))
    placed = carry_forward(parsed, ["file_name"], ["line_no", "line_id"], "__head", "entry")
    head = F.when(F.col("__head").isNotNull(), F.struct(*FIELDS))
    return placed.where("entry is not null").groupBy(F.col("entry").alias("line_id")).agg(F.count("*").alias("n_lines"), F.max(head).alias("__f")).select("line_id", "n_lines", "__f.*")


def single_lines(lines: DataFrame, layouts: list[dict], line_id: str = "line_id", text: str = "column_0") -> DataFrame:
    """Each row with a text as an entry of one line. A text without any layout's header is all message."""
    rows = lines.select(F.col(line_id).alias("line_id"), F.col(text).alias("line")).where(F.col(text).isNotNull()).dropDuplicates(["line_id"])
    parsed = parse_lines(rows, "line", layouts)
    return parsed.select("line_id", F.lit(1).cast("long").alias("n_lines"), *[_or(c) for c in FIELDS[:3]], F.coalesce("message", F.trim(plain(F.col("line")))).alias("message"))


def plain(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, "\\x1b\\[[0-9;]*[A-Za-z]", ""), "[\\s]+$", "")


def _or(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)
