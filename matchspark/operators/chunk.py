"""Descriptions cut into passages, with array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.arrays import let

LOW, HIGH, LEAST, PER_WORD = 200, 400, 50, 1.35
# How section headings begin.
SECTION_WORDS = (
    "responsibilit", "requirement", "qualification", "what you.ll do", "what we.re looking for", "who you are",
    "about (you|us|the role|the team|the company)", "must have", "nice to have", "preferred", "skills", "experience", "benefit", "perks",
    "compensation", "salary", "how to apply", "equal opportunit", "diversity",
)
# Bullets, openings of sections, ends of sentences.
BULLET = r"^\s*(?:[-*•‣◦⁃∙]|\d+[.)])\s+"
SECTION = r"(?i)^\s*(?:[#*\-•]\s*)?(?:" + "|".join(SECTION_WORDS) + ")"
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9])"
#: Marks of blocks and of those that open a section; removed from the input first.
_CUT, _OPENS = "\u0001", "\u0002"


def _strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def _n_words(x: Column) -> Column:
    """Runs of other characters than white space: what a split gives, less an empty string at either end."""
    blank = lambda c: F.when(c.rlike(r"\s"), 1).otherwise(0)
    return F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+")) - blank(F.left(x, F.lit(1))) - blank(F.right(x, F.lit(1))))


def estimate_tokens(text: Column) -> Column:
    return F.floor(_n_words(text) * F.lit(PER_WORD)).cast("int")


def clean_text(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]{2,}|\t", " ")
    return _strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def is_heading(line: Column) -> Column:
    """A short line that ends with a colon, is in capitals, or begins like a section."""

    def of(s: Column) -> Column:
        capitals = ~s.rlike("[a-z]") & (s == F.upper(s)) & (s != F.lower(s)) & (F.length(s) > 2)
        return (s != "") & (s.endswith(":") | capitals | s.rlike(SECTION)) & ~s.rlike(BULLET) & (_n_words(s) <= 8)

    return let(_strip(line), of)


def split_blocks(text: Column) -> Column:
    """Array of (body, opens): paragraphs, cut again before heading lines; opens marks a block that begins a section."""
    # a mark in the input is rare, and looking for it cheaper than taking it out
    plain = F.when(text.rlike(f"[{_CUT}{_OPENS}]"), F.translate(text, _CUT + _OPENS, "")).otherwise(text)
    paragraphs = F.filter(F.split(plain, r"\n\s*\n"), lambda p: p.rlike(r"\S"))
    # a mark before each line that begins a block, then one split at the marks
    marked = F.transform(paragraphs, lambda p: F.array_join(F.transform(F.split(p, "\n"), lambda x, i: F.concat(F.when(is_heading(x), _CUT + _OPENS).when(i == 0, _CUT).otherwise("\n"), x)), ""))
    blocks = F.transform(F.split(F.array_join(marked, ""), _CUT), lambda b: F.struct(_strip(F.when(b.startswith(_OPENS), F.substr(b, F.lit(2))).otherwise(b)).alias("body"), b.startswith(_OPENS).alias("opens")))
    return F.filter(blocks, lambda b: b["body"] != "")


def _fold(items: Column, full, sep: str) -> Column:
    """Greedy concatenation: ``full(state, item)`` tells when to begin anew; items are structs with body and n.

    The fold keeps the places of the cuts; bodies are joined once, between cuts,
    so that the work follows the length of the text.
    """
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        def moved(cut: Column) -> Column:
            return F.struct(F.when(cut, F.array_append(a["cuts"], a["at"])).otherwise(a["cuts"]).alias("cuts"), (a["at"] + 1).alias("at"), (F.when(cut, 0).otherwise(a["n"]) + x["n"]).alias("n"))

        return let((a["at"] > 0) & full(a, x), moved)

    def joined(all_items: Column) -> Column:
        cuts = F.aggregate(all_items, start, step, lambda a: F.concat(F.array(F.lit(0)), a["cuts"], F.array(a["at"])))
        held = F.struct(F.transform(all_items, lambda x: x["body"]).alias("bodies"), cuts.alias("cuts"))
        between = lambda h: F.transform(F.sequence(F.lit(1), F.size(h["cuts"]) - 1), lambda i: F.array_join(F.slice(h["bodies"], F.get(h["cuts"], i - 1) + 1, F.get(h["cuts"], i) - F.get(h["cuts"], i - 1)), sep))
        return F.when(F.size(all_items) > 0, let(held, between)).otherwise(F.array().cast("array<string>"))

    return let(items, joined)


def _counted(body: Column, opens: Column) -> Column:
    return F.struct(body.alias("body"), opens.alias("opens"), estimate_tokens(body).alias("n"))


def split_oversized(body: Column) -> Column:
    """A block of too many tokens packed by sentences; one that has none stays whole. What is too short for that many words is not counted."""
    sentences = F.transform(F.split(body, SENTENCE), lambda s: _counted(s, F.lit(False)))
    fits = (F.length(body) < 2 * int(HIGH / PER_WORD)) | (estimate_tokens(body) <= HIGH)
    return F.when(fits, F.array(body)).otherwise(_fold(sentences, lambda a, x: a["n"] + x["n"] > HIGH, " "))


def pack_chunks(parts: Column) -> Column:
    """Parts (body, opens, n) joined: a passage ends at a section start or before overflow, if it holds LOW tokens."""
    return _fold(parts, lambda a, x: (a["n"] >= LOW) & (x["opens"] | (a["n"] + x["n"] > HIGH)), "\n\n")


def merge_short(chunks: Column) -> Column:
    """Passages under LEAST tokens join the one before; a short first one joins the next."""
    start = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), F.concat(last, F.lit("\n\n"), x))
        return F.when((F.size(a) > 0) & (estimate_tokens(x) < LEAST), joined).otherwise(F.array_append(a, x))

    def finish(m: Column) -> Column:
        first, second = F.get(m, F.lit(0)), F.get(m, F.lit(1))
        rest = F.slice(m, F.lit(3), F.greatest(F.size(m) - 2, F.lit(0)))
        return F.when((F.size(m) > 1) & (estimate_tokens(first) < LEAST), F.concat(F.array(F.concat(first, F.lit("\n\n"), second)), rest)).otherwise(m)

    return F.aggregate(chunks, start, step, finish)


def chunk_jobs(jobs: DataFrame, chunks: DataFrame | None = None, text: str = "description") -> DataFrame:
    """job_id, chunk_index, text of jobs without passages yet; blank texts give no row, others at least one."""
    todo = jobs if chunks is None else jobs.join(chunks.select("job_id").hint("merge"), "job_id", "left_anti")
    # blank texts are found as they came, so that nothing is cleaned twice
    rows = todo.where(F.col(text).rlike(r"\S")).select("job_id", split_blocks(clean_text(F.col(text))).alias("b"))
    parts = F.flatten(F.transform("b", lambda b: F.transform(split_oversized(b["body"]), lambda p, i: _counted(p, b["opens"] & (i == 0)))))
    # exploded as it is made: from a column of its own Spark would infer a filter on its size, and make all passages twice
    return rows.select("job_id", F.posexplode(merge_short(pack_chunks(parts))).alias("chunk_index", "text"))
