"""Unified patches between two versions of a text: a shortest edit script, its hunks and the text around them.

Hunks follow the rules that published patches of this kind pin: ``unified`` lines of context before; a hunk closes
after ``unified`` unchanged lines, and the next may repeat them as its own context; the header's counts leave out the
line that closed the hunk. With a ``member`` pattern a hunk begins at the nearest member start within ``unified``
lines above, if there is one, and ends at the next line that is indented like it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import compare

UNIFIED = 3


def split_lines(text: str | None) -> list[str]:
    """Lines ended by LF, CRLF or CR; a last line end opens no line."""
    if not text:
        return []
    parts = re.split("\r\n|\n|\r", text)
    return parts[:-1] if parts[-1] == "" else parts


def edit_script(old: list[str], new: list[str]) -> list[str]:
    """A shortest script of " ", "-" and "+" (greedy furthest-reaching paths); removals come before additions."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    reach, trace = {1: 0}, []
    for d in range(len(a) + len(b) + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1] < reach[k + 1])
            x = reach[k + 1] if down else reach[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reach[k] = x
            if x >= len(a) and x - k >= len(b):
                break
        else:
            continue
        break
    script: list[str] = []
    x, y = len(a), len(b)
    for d in range(len(trace) - 1, 0, -1):
        before, k = trace[d], x - y
        down = k == -d or (k != d and before[k - 1] < before[k + 1])
        px = before[k + 1] if down else before[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > px + (not down) and y > py + down:
            script.append(" ")
            x, y = x - 1, y - 1
        script.append("+" if down else "-")
        x, y = px, py
    script += " " * x
    return [" "] * head + _removals_first(script[::-1]) + [" "] * tail


def _removals_first(script: list[str]) -> list[str]:
    out, run = [], []
    for op in [*script, " "]:
        if op == " ":
            out += sorted(run, reverse=True) + [" "]  # "-" sorts after "+"
            run = []
        else:
            run.append(op)
    return out[:-1]


class Run(NamedTuple):
    """Lines removed and lines added at one place, as ranges of both texts' lines."""

    old: range
    new: range


def changed_runs(script: list[str]) -> list[Run]:
    out, i, j = [], 0, 0
    for same, ops in groupby(script, lambda op: op == " "):
        ops = [*ops]
        old, new = len(ops) - ops.count("+"), len(ops) - ops.count("-")
        if not same:
            out.append(Run(range(i, i + old), range(j, j + new)))
        i, j = i + old, j + new
    return out


def clusters(runs: list[Run], unified: int) -> list[list[Run]]:
    """Runs with fewer than ``unified`` unchanged lines between them share a hunk."""
    out: list[list[Run]] = []
    for run in runs:
        if out and run.old.start - out[-1][-1].old.stop < unified:
            out[-1].append(run)
        else:
            out.append([run])
    return out


def _hunk(a: list[str], b: list[str], runs: list[Run], unified: int, member: re.Pattern | None) -> str:
    first, last = runs[0], runs[-1]
    above = range(max(0, first.old.start - unified), first.old.start)
    begins = next((n for n in reversed(range(above.start, min(above.stop + 1, len(a)))) if member.search(a[n])), None) if member else None
    top = above.start if begins is None else begins
    below = min(unified, len(a) - last.old.stop)
    lines = [f" {x}" for x in a[top : first.old.start]]
    for run, until in zip(runs, [*(r.old.start for r in runs[1:]), last.old.stop + below], strict=True):
        lines += [f"-{a[n]}" for n in run.old] + [f"+{b[n]}" for n in run.new] + [f" {x}" for x in a[run.old.stop : until]]
    # The header counts up to the line before the closing one; where the text ends in a change, the side written first counts one more.
    counted = below - (below == unified)
    n_old, n_new = (r.stop + counted - at for r, at in ((last.old, top), (last.new, top + first.new.start - first.old.start)))
    if not below:
        n_old, n_new = n_old + bool(last.new), n_new + (not last.new)
    if begins is not None:
        indent = a[top][: len(a[top]) - len(a[top].lstrip())]
        edited = last.old.stop - (not last.new)
        below_it = range(edited, min(len(a), edited + unified, top + n_old - 1))
        end = next((n for n in below_it if a[n].startswith(indent) and a[n].removeprefix(indent)[:1].strip()), None)
        if end is not None:
            beyond = top + n_old - 1 - end
            lines, n_old, n_new = lines[:-beyond], n_old - beyond, n_new - beyond
    return "".join(f"{x}\n" for x in [f"@@ -{top + 1},{n_old} +{top + first.new.start - first.old.start + 1},{n_new} @@", *lines])


def hunks(old: str | None, new: str | None, unified: int = UNIFIED, member: str | None = None) -> list[str]:
    """The text of each hunk, header first, every line ended by a line feed."""
    if unified < 2:
        raise ValueError("unified must be at least 2")
    a, b = split_lines(old), split_lines(new)
    starts = re.compile(member) if member else None
    return [_hunk(a, b, runs, unified, starts) for runs in clusters(changed_runs(edit_script(a, b)), unified)]


def with_hunks(pairs: DataFrame, unified: int = UNIFIED, member: str | None = None) -> DataFrame:
    """``pairs`` (``old_text, new_text``; null: no such side) with ``hunks array<string>``."""
    ship_package(pairs.sparkSession)

    @F.pandas_udf("array<string>")
    def make(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in batches:
            yield pd.Series([hunks(x, y, unified, member) for x, y in zip(old, new, strict=True)])

    return pairs.withColumn("hunks", make("old_text", "new_text"))


def file_sections(changes: DataFrame, blobs: DataFrame, start: str | None, end: str, unified: int = UNIFIED, member: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Each change with its ``section``: paths, index line and hunks, or a note that binary files differ.

    ``blobs``: ``oid, text, is_text``. ``start`` and ``end`` are the commits' ids.
    """
    side = lambda n: blobs.select(F.col("oid").alias(f"{n}_oid"), F.col("text").alias(f"{n}_text"), F.col("is_text").alias(f"{n}_is_text"))
    joined = changes.join(side("old"), "old_oid", "left").join(side("new"), "new_oid", "left")
    plain = F.coalesce("old_is_text", F.lit(True)) & F.coalesce("new_is_text", F.lit(True))
    joined = with_hunks(joined.withColumn("_plain", plain).withColumn("old_text", F.when(plain, F.col("old_text"))).withColumn("new_text", F.when(plain, F.col("new_text"))), unified, member)
    index = F.lit(f"index {start[:7] if start else 'null'}..{end[:7]} ")
    path = lambda mark, p: F.concat(F.lit(mark), F.coalesce(p, F.lit("dev/null")), F.lit("\n"))
    body = F.when(F.col("_plain"), F.array_join("hunks", "")).otherwise(F.lit("Binary files differ\n"))
    section = F.concat(path("--- a/", F.col("old_path")), path("+++ b/", F.col("new_path")), index, F.coalesce("new_mode", "old_mode"), F.lit("\n"), body)
    return joined.select(*by, *compare.CHANGE, section.alias("section"))


def header(author_name, author_email, epoch, tz_min, message, start: str | None):
    """A patch's first lines as a column. Times are the author's local ones; the zone is always written +0000."""
    local = F.timestamp_seconds(epoch + tz_min * 60)
    day = lambda pattern: F.date_format(local, pattern)
    first = F.concat(F.lit(f"From {start} "), day("EEE MMM dd HH:mm:ss yyyy"), F.lit("\n")) if start else F.lit("")
    return F.concat(first, F.lit("From: "), author_name, F.lit(" <"), author_email, F.lit(">\nDate: "), day("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000\nSubject: [PATCH] "), message, F.lit("\n\n"))


def patches(sections: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``by, patch``: diff statistics and all sections of a group, in path order."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(compare.result_order().alias("k"), "section"))), lambda x: x["section"]), "")
    texts = sections.groupBy(*by).agg(ordered.alias("sections"))
    return compare.diffstat(sections, by).join(texts, list(by)).select(*by, F.concat("diffstat", "sections").alias("patch"))
