"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above. SQL functions only.

The files are read once: each becomes a slim row with its lines that speak of a licence, the licence texts that its
vocabulary allows, and the text itself only if it has either. Everything else works on these rows.

Every line that speaks of a licence, wherever it stands in a file, is a header candidate. Equal lines are scored
once (so a line that a third of all files carry is one row), over words weighted by their rarity among all
distinct candidate lines and templates; the dot products come from a join on words with the template vectors, a
fixed list that is small enough to broadcast. A line whose best cosine reaches ``least`` names the file's licence;
of several lines the best one counts, ties go to the first name in the alphabet.

Licence texts and standard notices (``license_texts`` and ``NOTICES``) are looked for in all files, whatever their
lines: windows of each template's own number of words, an eighth of it apart, and the whole text; equal texts are
scored once. Weights, ``(1 + ln tf) * idf``, come from these templates alone. A window that reaches ``LEAST_TEXT``
counts as one more header; a whole text that does is a licence file. Files are ruled out first by a bound: a cosine
of c needs c * c of the template's squared weight in words that the file has.

A file that is a licence itself (its whole text, not a line, reaches ``least_file``, or is a licence text) speaks for
its directory. A file without a licence of its own inherits from the nearest directory on its path that has one:
distinct directories are exploded to their ancestors, joined to the licensed ones, and the deepest is joined back.

Defined results: null and empty texts have no candidate lines; files with a null path are in no directory and
inherit nothing. Every row is judged for itself, so repeated rows, repeated ids and null ids get a result each. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinmark.llm._common import stored

#: Licence names and the sentences that announce them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
SPEAKS = "(?i)licen[sc]|spdx|public domain"
WORD = "[a-z0-9]+(?:\\.[0-9]+)*"
LEAST, LEAST_FILE = 0.7, 0.45
LEAST_TEXT = 0.75
#: Standard notices of several lines.
_GNU = (
    "{this} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, "
    "either version {v} of the License, or (at your option) any later version. {this} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. "
    "You should have received a copy of the GNU {kind} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
NOTICES = (
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", _GNU.format(this="This program", kind="General Public License", v="2")),
    ("GPL-3.0", _GNU.format(this="This program", kind="General Public License", v="3")),
    ("LGPL-3.0", _GNU.format(this="This library", kind="Lesser General Public License", v="3")),
    ("AGPL-3.0", _GNU.format(this="This program", kind="Affero General Public License", v="3")),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def counted(units: DataFrame) -> DataFrame:
    """unit, word, tf of (unit, text)."""
    return units.select("unit", F.explode(words(F.col("text"))).alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf"))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """unit, name, text of a fixed list."""
    rows = [F.struct(F.lit(k).alias("unit"), F.lit(name).alias("name"), F.lit(text).alias("text")) for k, (name, text) in enumerate(templates)]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def best_match(units: DataFrame, weights: DataFrame, unseen: float, templates: DataFrame, least: float) -> DataFrame:
    """unit, name, score: each unit's best template from ``least`` on. Words without a weight count like unseen ones."""
    tf = counted(units).join(weights, "word", "left")
    vec = tf.select("unit", "word", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("v"))
    norms = vec.groupBy("unit").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    # vectors of the fixed templates: a few hundred rows
    dots = vec.join(F.broadcast(templates), "word").groupBy("unit", "t", "name", "tn").agg(F.sum(F.col("v") * F.col("tv")).alias("dot"))
    scored = dots.join(norms, "unit").select("unit", "name", F.round(F.col("dot") / (F.col("norm") * F.col("tn")), 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("m"))
    return best.select("unit", F.col("m.name").alias("name"), (-F.col("m.s")).alias("score"))


def text_templates() -> list[tuple[str, str]]:
    """(name, text) of the licence texts and notices; the two-clause BSD text is the other one without its third clause."""
    texts = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    three = dict(texts)["BSD-3-Clause"]
    two = three[: three.index("3. Neither")] + three[three.index("THIS SOFTWARE") :]
    return [*texts, ("BSD-2-Clause", two), *NOTICES]


def text_vectors(spark: SparkSession) -> DataFrame:
    """t, name, length, word, idf, share (of the template's squared weight) and v (of the unit vector): a few thousand
    rows, whatever the files are."""
    fixed = text_templates()
    templates = template_table(spark, fixed)
    tf = counted(templates)
    idf = tf.groupBy("word").agg((F.log(F.lit(len(fixed) + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    vec = tf.join(idf, "word").select("unit", "word", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = vec.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    named = templates.select("unit", "name", F.size(words(F.col("text"))).alias("length"))
    unit = vec.join(norm, "unit").join(named, "unit").withColumn("v", F.col("w") / F.col("norm"))
    return stored(unit.select(F.col("unit").alias("t"), "name", "length", "word", "idf", (F.col("v") * F.col("v")).alias("share"), "v").coalesce(1), "templates")


def with_allowed(base: DataFrame, vectors: DataFrame) -> DataFrame:
    """``base`` with the column allowed: the numbers of the templates that the words of text do not rule out."""
    heaviest_first = Window.partitionBy("t").orderBy(F.desc("share"), "word")
    ranked = vectors.select("t", "word", "share", F.row_number().over(heaviest_first).alias("k"), F.sum("share").over(heaviest_first).alias("upto"))
    enough = LEAST_TEXT * LEAST_TEXT - 1e-9
    # lists of the fixed templates' words, which are letters, digits and points and need no quoting
    rows = ranked.groupBy("t").agg(F.collect_list(F.struct("word", "share")).alias("of"), F.min(F.when(F.col("upto") >= enough, F.col("k"))).alias("needed")).orderBy("t").collect()
    listed = lambda found: ", ".join(f"'{x}'" for x in sorted(found))
    known = F.expr(f"filter(array_distinct(w), x -> x in ({listed({x['word'] for r in rows for x in r['of']})}))")
    fits = []
    for r in rows:
        shares = {x["word"]: x["share"] for x in r["of"]}
        of_template = f"map_from_arrays(array({', '.join(f"'{x}'" for x in shares)}), array({', '.join(f'{v!r}D' for v in shares.values())}))"
        many = F.expr(f"size(filter(terms, x -> x in ({listed(shares)}))) >= {r['needed']}")
        heavy = F.expr(f"aggregate(terms, 0D, (sum, x) -> sum + coalesce(try_element_at({of_template}, x), 0D)) >= {enough!r}D")
        fits.append(F.when(many & heavy, F.lit(r["t"])))
    some = F.when(F.size("terms") >= min(r["needed"] for r in rows), F.array_compact(F.array(*fits)))
    cut = base.select("*", words(F.col("text")).alias("w"))
    return cut.select(*base.columns, known.alias("terms")).select(*base.columns, some.alias("allowed"))


def text_matches(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """digest, name, score, whole (is it the whole text) of the licence texts and notices in (digest, text, allowed)."""
    unseen = math.log(len(text_templates()) + 1) + 1
    lengths = vectors.select("t", "name", "length").distinct()
    idf = vectors.select("word", "idf").distinct()
    cut = texts.select("digest", words(F.col("text")).alias("w"), F.explode("allowed").alias("t")).join(F.broadcast(lengths), "t")
    step = F.greatest(F.lit(1), F.floor(F.col("length") / 8)).cast("int")
    last = F.greatest(F.lit(1), F.size("w") - F.col("length") + 1)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, step), F.array(last)))
    spots = cut.select("digest", "t", "name", "w", "length", F.explode(F.concat(F.array(F.lit(0)), starts)).alias("start"))
    part = F.when(F.col("start") == 0, F.col("w")).otherwise(F.slice("w", F.greatest("start", F.lit(1)), F.col("length")))
    inside = spots.select("digest", "t", "name", "start", F.explode(part).alias("word")).groupBy("digest", "t", "name", "start", "word").agg(F.count("*").alias("tf"))
    weighed = inside.join(F.broadcast(idf), "word", "left").withColumn("x", (1 + F.log("tf")) * F.coalesce("idf", F.lit(unseen)))
    both = weighed.join(F.broadcast(vectors.select("t", "word", "v")), ["t", "word"], "left")
    scored = both.groupBy("digest", "t", "name", "start").agg(F.round(F.coalesce(F.sum(F.col("x") * F.col("v")), F.lit(0.0)) / F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("score"))
    return scored.where(F.col("score") >= LEAST_TEXT).select("digest", "name", "score", (F.col("start") == 0).alias("whole"))


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, least: float = LEAST, least_file: float = LEAST_FILE) -> DataFrame:
    """Per file: the id, path, n_headers, own (licence or null), own_score, is_license_file, license (own or
    inherited, else null), from_dir (null unless inherited)."""
    spark = files.sparkSession
    vectors = text_vectors(spark)
    speaks = lambda c: c.rlike(SPEAKS)
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    lines = F.when(speaks(F.col("text")), F.transform(F.filter(F.split("text", "\n"), speaks), lambda x: F.trim(x)))
    slim = with_allowed(base, vectors).withColumn("lines", lines)
    telling = (F.size("lines") > 0) | (F.size("allowed") > 0)
    slim = slim.select(F.monotonically_increasing_id().alias("row"), "id", "path", "lines", "allowed", F.when(telling, F.sha2("text", 256)).alias("digest"), F.when(telling, F.col("text")).alias("text"))
    slim = stored(slim, "slim")

    # lines and whole texts to the announcements
    of_row = slim.where(F.size("lines") > 0).select("row", "digest", F.explode("lines").alias("line"))
    distinct = stored(of_row.select(F.col("line").alias("text")).distinct(), "lines").withColumn("unit", F.col("text"))
    announced = template_table(spark, TEMPLATES)
    tf = counted(announced)
    total = distinct.count() + len(TEMPLATES)
    weights = counted(distinct).select("word").unionByName(tf.select("word")).groupBy("word").agg((F.log(F.lit(total + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    weights, unseen = stored(weights, "weights"), math.log(total + 1) + 1
    own = tf.join(weights, "word").select(F.col("unit").alias("t"), "word", (F.col("tf") * F.col("idf")).alias("tv"))
    sizes = own.groupBy("t").agg(F.sqrt(F.sum(F.col("tv") * F.col("tv"))).alias("tn"))
    table = stored(own.join(sizes, "t").join(announced.select(F.col("unit").alias("t"), "name"), "t").coalesce(1), "announced")
    by_line = stored(best_match(distinct, weights, unseen, table, least).select(F.col("unit").alias("line"), "name", "score"), "headers")
    best = lambda name, score: F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("name")))
    heads = stored(of_row.join(by_line, "line").groupBy("row", "digest").agg(F.count("*").alias("n"), best("name", "score").alias("m")), "heads")
    texts = slim.where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"), F.first("allowed").alias("allowed"))
    whole = texts.join(heads.select("digest").distinct(), "digest", "left_semi").select(F.col("digest").alias("unit"), "text")
    as_file = best_match(whole, weights, unseen, table, least_file).select(F.col("unit").alias("digest"), F.struct((-F.col("score")).alias("s"), "name").alias("f"))

    # windows and whole texts to the licence texts
    found = text_matches(texts.where(F.size("allowed") > 0), vectors)
    at = F.struct((-F.col("score")).alias("s"), "name")
    found = found.select("digest", at.alias("m"), F.when(F.col("whole"), at).alias("f"))
    judged = stored(found.unionByName(as_file.select("digest", F.lit(None).cast("struct<s:double,name:string>").alias("m"), "f")).groupBy("digest").agg(F.min("m").alias("m"), F.min("f").alias("f")), "judged")

    marked = slim.select("row", "id", "path", "digest", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    marked = marked.join(heads.select("row", "n", F.col("m").alias("h")), "row", "left").join(judged, "digest", "left")
    mine = F.when(F.col("h").isNull(), F.col("m")).when(F.col("m").isNull(), F.col("h")).otherwise(F.least("h", "m"))
    marked = marked.select("id", "path", "dir", (F.coalesce("n", F.lit(0)) + F.col("m").isNotNull().cast("int")).cast("long").alias("n_headers"), mine.alias("own"), "f")
    marked = stored(marked, "marked")
    speakers = marked.where("f is not null and path is not null").groupBy(F.col("dir").alias("above")).agg(F.min("f").alias("f")).select("above", F.col("f.name").alias("given"))
    parts = F.split("dir", "/")
    upward = F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "above")
    dirs = marked.where("path is not null").select("dir").distinct().select("dir", upward)
    nearest = dirs.join(speakers, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("m")).select("dir", F.col("m.above").alias("above"), F.col("m.given").alias("given"))
    out = marked.join(nearest, "dir", "left")
    inherits = F.col("own").isNull() & F.col("path").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", "n_headers", F.col("own.name").alias("own"), (-F.col("own.s")).alias("own_score"), F.col("f").isNotNull().alias("is_license_file"),
        F.coalesce("own.name", F.when(inherits, F.col("given"))).alias("license"), F.when(inherits, F.col("above")).alias("from_dir"),
    )
