"""Licence scans (operator 8, DataFrame functions only).

A unit of text is compared to licence templates by the Dice coefficient of their
sets of word bigrams: twice the number shared over the sum of the sizes. Units of a
text are its sentences (which end at a line break, or at spaces after ``.``, ``!`` or
``?``), its lines of several sentences, and the text if it has several lines. A coefficient
of ``least`` bounds the ratio of two set sizes by least / (2 - least), so a unit whose
size is in no template's bounds is dropped before its bigrams are made, and a pair out
of bounds before it is counted. The same bound asks a unit to share least / (2 - least)
of a template's bigrams; a text that as a whole shares fewer with every template holds
no such unit and is dropped first. Bigrams that no template has only count for the size.

With ``passages``, runs of two or more neighbouring sentences are units too, across
lines, whose breaks read as spaces: a licence wrapped above other text is one. Only runs
that begin and end with a bigram of the template found nowhere else in the run are
tried; any other run has a shorter one inside it that scores as much or more. Runs with
more distinct bigrams than a template's bound are not looked at, so work grows with the
length of a text also where it holds a licence very often.

Normalised text: lower case, every run of other characters than letters and digits is
one space. A unit of one word has that word as its bigram. Null, empty and wordless
texts match nothing. Repeated rows are scanned once each, and documents are told apart
by id and text. Control characters 1 and 2 end lines and sentences. Rows without an id
are scanned too. An empty table gives no rows; extra
columns are not read. The templates below are a fixed table, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, table

#: Published licence notices and texts; fixed values.
TEMPLATES = {
    "apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit notice": "Released under the MIT License.",
    "mit licensed": "Licensed under the MIT License.",
    "mit text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "cc-by-nc-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0 notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0 sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0 sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "isc text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
        "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense notice": "This is free and unencumbered software released into the public domain.",
    "all rights reserved": "All rights reserved.",
}


LINE, SENTENCE = "\x01", "\x02"
LAST = 2**31 - 1
#: Lengths of runs, in pairs of words, for which distinct pairs are bounded.
REACHES = (1 << 10, 1 << 14, 1 << 18, LAST)
SPACES = r"[ \t\r\f\x0B]"


def normalised(text: Column) -> Column:
    """Words at single spaces, with marks where lines and sentences end."""
    marked = F.regexp_replace(F.regexp_replace(text, f"([.!?]){SPACES}+", f"$1{SENTENCE}"), rf"{SENTENCE}?{SPACES}*\n\s*", LINE)
    return F.lower(F.regexp_replace(marked, r"[^\p{L}\p{N}\x01\x02]+", " "))


def units(norm: Column) -> Column:
    """(unit, its place among its kind, piece) of all sentences, lines and the text."""
    several = F.transform(F.split(norm, LINE), lambda x: F.when(F.contains(x, F.lit(SENTENCE)), x).otherwise(""))
    named = lambda kind, pieces: F.transform(pieces, lambda x, i: F.struct(F.lit(kind).alias("unit"), i.alias("at"), F.trim(F.regexp_replace(x, "[ \x01\x02]+", " ")).alias("piece")))
    whole = F.filter(F.array(norm), lambda x: F.contains(x, F.lit(LINE)))
    return F.concat(named("sentence", F.split(norm, "[\x01\x02]")), named("line", several), named("text", whole))


def bigrams(w: Column) -> Column:
    """Distinct bigrams of a list of words that isn't empty."""
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(w) == 1, w).otherwise(pairs))


def sharing(texts: DataFrame, sets: dict[str, set[str]], part: float) -> DataFrame:
    """Texts that share ``part`` of the bigrams of some template; decided in the row, by
    hashes, so that no text is sent."""
    spark = texts.sparkSession
    pairs = {g for s in sets.values() for g in s}
    halves = spark.createDataFrame([g.partition(" ")[::2] for g in sorted(pairs)], "a string, b string")
    code = {f"{r.a} {r.b}": r.h for r in halves.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}  # the templates' bigrams
    fixed = lambda grams: F.array(*[F.lit(x) for x in sorted(code[g] for g in grams)])
    plain = F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), " ")
    every = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    least = min(part * len(s) for s in sets.values()) - 1e-9
    holds = F.lit(False)
    for s in sets.values():
        holds = holds | (F.size(F.array_intersect("hits", fixed(s))) >= part * len(s) - 1e-9)
    met = settled(settled(texts, "words", plain), "hits", F.array_intersect(every(F.col("words")), fixed(pairs)))
    return met.where(F.size("hits") >= least).where(holds).drop("words", "hits")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """With a column computed once: later filters don't move in front of it and
    repeat it."""
    return df.withColumn(name, F.explode(F.array(value)))


def passages_of(texts: DataFrame, sets: dict[str, set[str]], least: float) -> DataFrame:
    """(text_hash, licence, first, last, first_line, last_line, dice): for each first
    sentence the shortest run that reaches ``least``, with the best coefficient of its runs."""
    spark = texts.sparkSession
    low, high = least / (2 - least), (2 - least) / least
    rows = [(name, len(s), *g.partition(" ")[::2]) for name, s in sets.items() for g in sorted(s)]
    marks = spark.createDataFrame(rows, "licence string, size int, a string, b string").select("licence", "size", F.xxhash64("a", "b").alias("pair"))
    sentences = F.flatten(F.transform(F.split("norm", LINE), lambda x, i: F.transform(F.split(x, SENTENCE), lambda y: F.struct(i.alias("line"), F.trim(y).alias("words")))))
    placed = F.filter(F.transform(sentences, lambda x, i: F.struct(i.alias("at"), x["line"].alias("line"), x["words"].alias("words"))), lambda x: x["words"] != "")
    words = F.flatten(F.transform("pieces", lambda x, k: F.transform(F.split(x["words"], " "), lambda w, i: F.struct(k.alias("k"), i.alias("i"), w.alias("w")))))
    pair = lambda x, y: F.struct(F.xxhash64(x["w"], y["w"]).alias("pair"), x["k"].alias("a"), y["k"].alias("b"))
    once = settled(settled(texts, "norm", normalised(F.col("text"))), "pieces", placed)
    once = settled(once.select("text_hash", F.transform("pieces", lambda x: F.struct(x["at"], x["line"])).alias("places"), words.alias("w")).where(F.size("w") > 1), "pairs", F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), pair))
    opens = F.filter(F.transform("w", lambda x, i: F.when(x["i"] == 0, i)), lambda i: i.isNotNull())  # word that each sentence begins with
    every = once.select("text_hash", F.posexplode("pairs").alias("pos", "p")).select("text_hash", "pos", "p.*")
    same, text = Window.partitionBy("text_hash", "pair").orderBy("pos"), Window.partitionBy("text_hash").orderBy("pos")
    every = every.select("*", F.lag("pos").over(same).alias("back"), F.lag("a").over(same).alias("before"), F.lead("b").over(same).alias("again"))
    # A run of at most ``reach`` pairs has no fewer distinct ones than it has pairs whose
    # last one lies further back than ``reach``. Where more than ``most`` of these follow
    # sentence ``left`` within ``reach``, no run can begin there or before.
    most = int(high * max(len(s) for s in sets.values()) + 1e-9) + 1
    for k, reach in enumerate(REACHES):
        far = F.when(F.col("back").isNull() | (F.col("pos") - F.col("back") > reach), F.struct("pos", "a"))
        every = every.withColumn(f"far{k}", far).withColumn(f"far{k}", F.expr(f"lag(far{k}, {most}) ignore nulls over (partition by text_hash order by pos)"))
    left = F.greatest(F.lit(-1), *(F.when(F.col("pos") - F.col(f"far{k}.pos") < reach, F.col(f"far{k}.a")) for k, reach in enumerate(REACHES)))
    key = ["text_hash", "licence", "size"]
    hits = every.select("text_hash", "pair", "a", "b", "again", F.greatest(F.coalesce("before", F.lit(-1)), left).alias("before")).join(F.broadcast(marks), "pair")
    # A run is no better than the one without its first sentence from where all of the
    # sentence's bigrams have come again.
    starts = hits.groupBy(*key, F.col("a").alias("first")).agg(F.max(F.coalesce("again", F.lit(LAST))).alias("until"))
    # For each first sentence, where each of the template's bigrams ends that follows first.
    ends = (
        hits.where(F.col("before") < F.col("a"))
        .select(*key, F.explode(F.sequence(F.col("before") + 1, F.col("a"))).alias("first"), F.col("b").alias("last"))
        .groupBy(*key, "first", "last").agg(F.count(F.lit(1)).alias("here"))
        .join(starts, [*key, "first"]).where(F.col("last") < F.col("until"))
    )
    upto = Window.partitionBy(*key, "first").orderBy("last").rowsBetween(Window.unboundedPreceding, 0)
    tried = (
        ends.withColumn("both", F.sum("here").over(upto))
        .where((F.col("both") >= low * F.col("size") - 1e-9) & (F.col("last") > F.col("first")))
        .groupBy("text_hash").agg(F.collect_list(F.struct("licence", "size", "first", "last", "both")).alias("runs"))
    )
    held = once.select("text_hash", "places", opens.alias("opens"), F.transform("pairs", lambda x: x["pair"]).alias("codes"))
    past = lambda x: F.coalesce(F.get("opens", x["last"] + 1), F.size("codes") + 1)
    own = lambda x: F.slice("codes", F.get("opens", x["first"]) + 1, past(x) - 1 - F.get("opens", x["first"]))
    place = lambda x: F.struct(
        x["licence"].alias("licence"), F.get("places", x["first"]).alias("begin"), F.get("places", x["last"]).alias("end"),
        (2 * x["both"] / (F.size(F.array_distinct(own(x))) + x["size"])).alias("dice"),
    )
    return (
        tried.join(held, "text_hash")
        .select("text_hash", F.explode(F.transform("runs", place)).alias("x")).select("text_hash", "x.*")
        .where(F.col("dice") >= least)
        .groupBy("text_hash", "licence", F.col("begin.at").alias("first"), F.col("begin.line").alias("first_line"))
        .agg(F.min("end").alias("end"), F.max("dice").alias("dice"))
        .select("text_hash", "licence", "first", "first_line", F.col("end.at").alias("last"), F.col("end.line").alias("last_line"), "dice")
    )


def free(found: DataFrame) -> Column:
    """Of units and passages of a text and licence: whether a row is a passage that shares
    no sentence with a unit."""
    key, passage = ["text_hash", "licence"], F.col("unit") == "passage"

    def clear(kind: str, first: str, last: str) -> Column:
        order = F.when(F.col("unit") == kind, F.col("at")).when(passage, F.col(first)).otherwise(-1)
        on = Window.partitionBy(*key).orderBy(order.desc(), passage.desc()).rowsBetween(Window.unboundedPreceding, 0)
        # Passages come before units of their place in this order, so equal places are looked at apart.
        here = F.max((F.col("unit") == kind).cast("int")).over(Window.partitionBy(*key, order))
        following = F.min(F.when(F.col("unit") == kind, F.col("at"))).over(on)
        return (here == 0) & (following.isNull() | (following > F.col(last)))

    whole = F.max((F.col("unit") == "text").cast("int")).over(Window.partitionBy(*key))
    return passage & (whole == 0) & clear("sentence", "first", "last") & clear("line", "first_line", "last_line")


def apart(passages: Column) -> Column:
    """Most passages that share no sentence with each other, of structs (last, first)."""
    none = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"))
    add = lambda s, x: F.when(x["first"] > s["last"], F.struct(x["last"].alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(F.array_sort(passages), none, add, lambda s: s["n"])


def python_bigrams(text: str) -> set[str]:
    w = "".join(c.lower() if c.isalnum() else " " for c in text).split()
    return {f"{a} {b}" for a, b in zip(w, w[1:])} or set(w)


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, str] = TEMPLATES, passages: bool = False) -> DataFrame:
    """(doc_id, text_hash, licence, dice, unit, n_units): for each document and licence,
    the best coefficient of ``least`` or more, the kind of unit that has it (``line``,
    ``sentence``, ``text`` or ``passage``), and how many of its units reach ``least``;
    passages count where they share no sentence with other units that do."""
    spark = docs.sparkSession
    sets = {name: python_bigrams(t) for name, t in templates.items()}
    sizes = sorted({len(s) for s in sets.values()})
    low, high = least / (2 - least), (2 - least) / least
    fits = F.expr(" or ".join(f"n between {low * s - 1e-9!r}D and {high * s + 1e-9!r}D" for s in sizes))
    rows = [(name, len(s), g) for name, s in sets.items() for g in sorted(s)]
    marks = F.broadcast(spark.createDataFrame(rows, "licence string, size int, gram string"))

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    if min(len(t.split()) for t in templates.values()) > 1:
        texts = sharing(texts, sets, low)
    # From here on few texts are left. Equal texts are judged once, and equal rows are one document.
    path = scratch(spark, "licences")
    texts.withColumn("text_hash", F.md5("text")).write.parquet(path)
    texts = spark.read.parquet(path)
    once = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    pieces = (
        settled(once, "norm", normalised(F.col("text")))
        .select("text_hash", F.posexplode(units(F.col("norm"))).alias("place", "u"))
        .where(F.col("u.piece") != "")
        .select("text_hash", "place", "u.unit", "u.at", F.split("u.piece", " ").alias("words"))
    )
    fitting = (
        # A set is no larger than its list, so the lower bound can go by the list.
        settled(pieces.where(F.size("words") >= low * sizes[0]), "grams", bigrams(F.col("words")))
        .select("text_hash", "unit", "at", "place", "grams", F.size("grams").alias("n"))
        .where(fits)
    )
    found = (
        fitting.select("*", F.explode("grams").alias("gram"))
        .join(marks, "gram")
        .where((F.col("n") >= low * F.col("size") - 1e-9) & (F.col("n") <= high * F.col("size") + 1e-9))
        .groupBy("text_hash", "unit", "at", "place", "n", "licence", "size")
        .agg(F.count(F.lit(1)).alias("both"))
        .select("text_hash", "licence", (2 * F.col("both") / (F.col("n") + F.col("size"))).alias("dice"), "unit", "at")
        .where(F.col("dice") >= least)
    )
    count = F.count(F.lit(1))
    if passages:
        found = found.unionByName(passages_of(once, sets, least).withColumn("unit", F.lit("passage")), allowMissingColumns=True)
        found = found.withColumn("free", free(found))
        count = F.count_if(F.col("unit") != "passage") + apart(F.collect_list(F.when(F.col("free"), F.struct("last", "first"))))
    best = F.max_by("unit", F.struct("dice", F.col("unit") != "passage", "unit"))
    judged = found.groupBy("text_hash", "licence").agg(F.round(F.max("dice"), 6).alias("dice"), best.alias("unit"), count.alias("n_units"))
    return texts.select("doc_id", "text_hash").distinct().join(judged, "text_hash").select("doc_id", "text_hash", "licence", "dice", "unit", "n_units")


def op8_license_scans(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), passages=True).drop("text_hash")


def oracle(least: float = 0.8) -> str:
    values = ",\n    ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in TEMPLATES.items())
    grams = "CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) END"
    split = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH templates(licence, text) AS (VALUES
    {values}
), marks AS (SELECT licence, {grams} AS t FROM (SELECT licence, {split.format("text")} AS w FROM templates)),
marked AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?]){SPACES}+', '\\1' || chr(2), 'g'), '\\x02?{SPACES}*\\n\\s*', chr(1), 'g') AS m FROM documents
), pieces AS (
  SELECT doc_id, 'text' AS unit, m AS piece FROM marked WHERE contains(m, chr(1))
  UNION ALL SELECT doc_id, 'line', line FROM (SELECT doc_id, unnest(string_split(m, chr(1))) AS line FROM marked) WHERE contains(line, chr(2))
  UNION ALL SELECT doc_id, 'sentence', unnest(regexp_split_to_array(m, '[\\x01\\x02]')) FROM marked
), sets AS (SELECT doc_id, unit, {grams} AS g FROM (SELECT doc_id, unit, {split.format("piece")} AS w FROM pieces) WHERE len(w) > 0),
scored AS (
  SELECT doc_id, unit, licence, 2 * len(list_intersect(g, t)) / (len(g) + len(t)) AS dice FROM sets JOIN marks
  ON len(g) BETWEEN {least / (2 - least)} * len(t) - 1e-9 AND {(2 - least) / least} * len(t) + 1e-9
)
SELECT doc_id, licence, round(max(dice), 6) AS dice, arg_max(unit, struct_pack(d := dice, u := unit)) AS unit, count(*) AS n_units
FROM scored WHERE dice >= {least} GROUP BY doc_id, licence
"""


SQL = oracle()
