"""Texts to vectors through a function of the caller's choice."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, BATCH, MOST_PLACES = 768, 32, 100_000
#: Rows whose vectors are held at once.
VECTORS = 2048
_TOKEN = re.compile(r"[^\W_]+")


def hashed_bag(width: int = WIDTH) -> Callable[[list[str]], list[np.ndarray]]:
    """An embedder without a model: word counts hashed to ``width`` places, at unit length."""

    place: dict[str, int] = {}  # of the tokens of this task; begun anew where they are many

    def embed(texts: list[str]) -> list[np.ndarray]:
        found = [_TOKEN.findall(text.lower()) for text in texts]
        if len(place) > MOST_PLACES:
            place.clear()
        for token in {x for tokens in found for x in tokens}.difference(place):
            place[token] = zlib.crc32(token.encode()) % width
        out = []
        for tokens in found:
            v = np.bincount(np.fromiter(map(place.__getitem__, tokens), np.int64, len(tokens)), minlength=width).astype(np.float32)
            n = float(np.sqrt((v * v).sum()))
            out.append(v / n if n else v)
        return out

    return embed


def embed_table(df: DataFrame, text_col: str, embedder: Callable | None = None, width: int = WIDTH, batch: int = BATCH, out_col: str = "vec") -> DataFrame:
    """df with a vector of each text, ``batch`` texts a call across rows. Blank texts get null; a wrong count or width is an error."""
    embed = embedder or hashed_bag(width)

    at, names = df.columns.index(text_col), [*df.columns, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for low in range(0, rows.num_rows, VECTORS):
                part = rows.slice(low, VECTORS)
                texts = part.column(at).to_pylist()
                full = [i for i, t in enumerate(texts) if t is not None and t.strip()]
                made = np.zeros((len(full), width), np.float32)
                for k in range(0, len(full), batch):
                    some = [texts[i] for i in full[k : k + batch]]
                    vectors = embed(some)
                    if len(vectors) != len(some):
                        raise ValueError(f"{len(vectors)} vectors for {len(some)} texts")
                    for i, v in enumerate(vectors):
                        if len(v) != width:
                            raise ValueError(f"a vector of width {len(v)}, not {width}")
                        made[k + i] = v
                given = np.zeros(len(texts), bool)
                given[full] = True
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(given) * width), pa.int32()), pa.array(made.reshape(-1)), mask=pa.array(~given))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, {out_col} array<float>")


def check_vectors(df: DataFrame, key: list[str], vec: str = "vec", width: int = WIDTH) -> DataFrame:
    """key and problem of vectors that are null, of another width, hold a null, or are zero."""
    v = F.col(vec)
    problem = F.when(v.isNull(), "null").when(F.size(v) != width, "width").when(F.exists(v, lambda x: x.isNull()), "null component").when(F.forall(v, lambda x: x == 0), "zero")
    return df.select(*key, problem.alias("problem")).where("problem is not null")


def resume_embedding_text(parsed: Column) -> Column:
    """Skills, roles and projects of a parsed résumé as text; contact data, education and durations stay out."""
    full = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    given = lambda x: F.nullif(F.trim(F.coalesce(x, F.lit(""))), F.lit(""))
    skills = full(parsed["skills"])
    roles = F.filter(F.transform(parsed["experience"], lambda e: F.concat_ws(" at ", given(e["role"]), given(e["company"]))), lambda x: x != "")

    def project(p: Column) -> Column:
        title, tech = F.coalesce(given(p["title"]), F.lit("")), F.array_join(full(p["tech"]), ", ")
        return F.when(tech == "", title).when(title == "", tech).otherwise(F.concat(title, F.lit(" ("), tech, F.lit(")")))

    projects = F.filter(F.transform(parsed["projects"], project), lambda x: x != "")
    part = lambda head, a, sep: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.concat(F.lit(head), F.array_join(a, sep)))
    return F.concat_ws("\n\n", part("Skills: ", skills, ", "), part("Roles: ", roles, "; "), part("Projects: ", projects, "; "))
