r"""License scans in DataFrame functions only: TF-IDF cosine of lines and whole files to templates, then inheritance along paths.

Terms are runs of [a-z0-9] after lowering A-Z, without stop words. A template's and a unit's vectors hold count times inverse document frequency
over the templates (in thousandths, whole numbers, so sums are exact); a term of no template weighs as much as one of a single template
would at most. Units are every line (a header) and the whole text (a license file); the best cosine of at least THRESHOLD names the license.
A line or text without any anchor term cannot reach the threshold: anchors are a template's heaviest terms, as many
as leave the rest too light. Of texts with an anchor, those whose terms hold too little of every template are out as well. So both tests, which are
exact, spare all other texts the vectors, and scanning explodes and shuffles nothing.

Notices (TEMPLATES) have one model, full license texts and standard headers (license_texts()) another, with anchors of its own and
TEXT_THRESHOLD. Its units are the whole text and runs of at most BLOCK adjacent paragraphs: lines without a letter or digit, and the border
between comment and code, part paragraphs, so a header wrapped in any way is found. The better score counts, a notice on a tie. An
SPDX-License-Identifier line names the own license with score 1, before both (its expression; -only, -or-later and + are left out of a single name).

A directory takes the license of the license files in it (whole texts over the threshold; the best cosine, ties by
name), and a file without a license of its own that of its nearest ancestor directory that has one: distinct directories
are exploded to their ancestors and joined by path, then files join their directory.

Defined cases: null text and null path count as empty; an empty text has no license of its own; repeated rows each give a row; an empty
table gives no rows; columns besides path and text are kept out of the vectors and returned as given.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from functools import cache
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, quoted, table

#: License notices, by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, ShareAlike.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software is granted under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
THRESHOLD = 0.6
#: Standard headers, by SPDX identifier; the full texts lie in the folder licenses.
_GNU = "{0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{4} either version {2} of the License, or (at your option) any later version. "
_GNU += "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with {5}"
_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
HEADERS = {
    "AGPL-3.0": _GNU.format("This program", "Affero General Public License", "3", ":", ",", "this program") + _SEE,
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-2.0": _GNU.format("This program", "General Public License", "2", ";", ";", "this program") + _WRITE,
    "GPL-3.0": _GNU.format("This program", "General Public License", "3", ":", ",", "this program") + _SEE,
    "LGPL-2.1": _GNU.format("This library", "Lesser General Public License", "2.1", ";", ";", "this library") + _WRITE,
    "LGPL-3.0": _GNU.format("This library", "Lesser General Public License", "3", ":", ",", "this library") + _SEE,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: The Affero text is version 3 of the GPL with its name and this section 13.
_AFFERO = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer
all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the
Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any
work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine
any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the
part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License.
"""
TEXT_THRESHOLD, BLOCK = 0.8, 8
#: Words of licenses that other texts hold too: anchors only where the others are not enough.
COMMON = ("above", "action", "additional", "all", "any", "apply", "are", "at", "be", "code", "deal", "do", "does", "following", "form", "free", "from", "general", "if", "including", "limited", "list", "make", "may", "mean", "means", "mit", "no", "not", "on", "other", "provided", "public", "rights", "such", "version", "work", "works", "you", "your")
#: Where a paragraph ends, where comment and code meet, and SPDX lines.
GAP, MARK, SPDX = r"\n(?:[^A-Za-z0-9\n]*\n)+", r"[ \t]*(?:#|//|/\*|\*|;|--|%|<!--)", r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)"
#: Words without weight: in full texts they would outweigh all others, and lines of nothing else would pass for notices.
STOP = ("a", "an", "and", "as", "by", "for", "in", "into", "is", "it", "of", "or", "that", "the", "this", "to", "under", "use", "with")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER))) if t not in STOP]


class Model:
    """Weights of terms, vectors of templates, and the anchors that a unit over the threshold must hold one of."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.names, self.threshold = sorted(templates), threshold
        counts = {n: Counter(terms(templates[n])) for n in self.names}
        df = Counter(t for c in counts.values() for t in c)
        self.weight = {t: round(1000 * (math.log((1 + len(counts)) / (1 + d)) + 1)) for t, d in sorted(df.items())}
        self.other = round(1000 * (math.log(1 + len(counts)) + 1))
        self.vectors = {n: {t: k * self.weight[t] for t, k in sorted(c.items())} for n, c in counts.items()}
        self.norms = {n: math.sqrt(sum(v * v for v in x.values())) for n, x in self.vectors.items()}
        self.anchors: set[str] = set()
        for n, x in self.vectors.items():
            left = sum(v * v for v in x.values())
            # numbers and words that stand in many texts come last
            for t, v in sorted(x.items(), key=lambda p: (p[0].isdigit() or p[0] in COMMON, -p[1], p[0])):
                if math.sqrt(left) / self.norms[n] < threshold - 1e-6:
                    break
                self.anchors.add(t)
                left -= v * v


def license_texts() -> dict[str, str]:
    """Full texts and headers, by identifier and '/text' or '/header'."""
    folder = resources("graphloom.llm") / "licenses"
    out = {f"{x.name.removesuffix('.txt')}/text": x.read_text(encoding="utf-8") for x in folder.iterdir() if x.name.endswith(".txt")}
    gpl = out["GPL-3.0/text"]
    before, after = gpl[: gpl.index("  13. Use with the GNU Affero")], gpl[gpl.index("  14. Revised Versions") :]
    renamed = [re.sub(r"(?i)(GNU)(\s+)(General\s+Public)", r"\1 Affero\2\3", x) for x in (before, after)]
    return out | {"AGPL-3.0/text": renamed[0] + _AFFERO + renamed[1]} | {f"{n}/header": x for n, x in HEADERS.items()}


@cache
def text_model() -> Model:
    return Model(license_texts(), TEXT_THRESHOLD)


def _words(values) -> str:
    return ", ".join(f"'{t}'" for t in values)


def _terms(text: str) -> str:
    """SQL of the array of a text's terms."""
    return f"filter(split(translate({text}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+'), t -> t <> '' and t not in ({_words(STOP)}))"


def _bind(value: str, name: str, use: str) -> str:
    """SQL of `use` with the value made once: the lambda of a one-element array names it."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


class Lookup:
    """SQL over a model's terms. A term's entry (t, w: its weight, v: its value in every template) stands in a constant array at its CRC-32, so a look-up costs the same at any vocabulary."""

    def __init__(self, model: Model):
        self.model, size = model, 1 << (4 * len(model.weight)).bit_length()
        places: list[list[dict]] = [[] for _ in range(size)]
        for t, w in model.weight.items():
            places[zlib.crc32(t.encode()) % size].append({"t": t, "w": w, "v": [model.vectors[n].get(t, 0) for n in model.names]})
        table = f"from_json('{json.dumps(places, separators=(',', ':'))}', 'array<array<struct<t:string,w:double,v:array<double>>>>')"
        self.entry = lambda t: f"get(filter(get({table}, cast(crc32({t}) % {size} as int)), e -> e.t = {t}), 0)"
        self.known = f"t in ({_words(model.weight)})"
        self.norms = f"array({', '.join(repr(model.norms[n]) + 'D' for n in model.names)})"
        self.zeros = f"array_repeat(0D, {len(model.names)})"

    def _total(self, hits: str, step: str) -> str:
        """For every template the sum of step (x: so far, y: the term's value, e: its entry) over an array of known terms."""
        return f"aggregate({hits}, {self.zeros}, (a, t) -> {_bind(self.entry('t'), 'e', f'zip_with(a, e.v, (x, y) -> {step})')})"

    def possible(self, own: str) -> str:
        """Whether a text of these terms, or a part of it, can reach the threshold: it has an anchor and, by the inequality of Cauchy and Schwarz, no cosine is
        above the share that the template's terms in the text have of its length."""
        held = self._total(f"array_distinct(filter({own}, t -> {self.known}))", "x + y * y")
        least = (self.model.threshold - 1e-6) ** 2
        return f"exists({own}, t -> t in ({_words(sorted(self.model.anchors))})) and exists(zip_with({held}, {self.norms}, (h, m) -> h >= {least!r}D * m * m), z -> z)"

    def _squares(self, own: str, weight: str) -> str:
        """The sum of (count * weight) ** 2 over the distinct terms: runs of equal ones in sorted order."""
        square = f"pow(a.run * ({weight}), 2D)"
        step = f"case when t = a.term then named_struct('term', a.term, 'run', a.run + 1D, 'total', a.total) else named_struct('term', t, 'run', 1D, 'total', a.total + {square}) end"
        return f"aggregate(sort_array({own}), named_struct('term', '', 'run', 0D, 'total', 0D), (a, t) -> {step}, a -> a.total + {square})"

    def best(self, unit: str, first: int = 0) -> str:
        """(score, place) of the unit's best template, null below the threshold; place is minus its number from `first` on, so the greatest struct prefers the first name."""
        dots = self._total("p.hits", "x + y * e.w")
        scores = f"zip_with({dots}, {self.norms}, (d, m) -> case when norm > 0 then round(d / (norm * m), 6) else 0D end)"
        chosen = f"array_max(transform({scores}, (s, k) -> case when s >= {self.model.threshold}D then named_struct('score', s, 'place', -{first} - k) end))"
        own_weight = f"case when a.run > 0 then {self.entry('a.term')}.w else 0D end"
        norm = f"sqrt({self._squares('p.hits', own_weight)} + {self._squares('p.rest', f'{float(self.model.other)}D')})"
        parted = f"named_struct('hits', filter(own, t -> {self.known}), 'rest', filter(own, t -> not ({self.known})))"
        return _bind(_terms(unit), "own", _bind(parted, "p", _bind(norm, "norm", chosen)))


def blocks(text: str) -> str:
    """SQL of the runs of at most BLOCK adjacent paragraphs."""
    marked = f"regexp_replace(regexp_replace({text}, r'(?m)^({MARK}[^\n]*)\n(?!{MARK})', '$1\n\n'), r'(?m)^(?!{MARK})([^\n]*)\n(?={MARK})', '$1\n\n')"
    runs = f"flatten(transform(p, (x, i) -> transform(sequence(1, least({BLOCK}, size(p) - i)), n -> array_join(slice(p, i + 1, n), '\n'))))"
    return _bind(f"split({marked}, r'{GAP}')", "p", runs)


def spdx(text: Column) -> Column:
    """The expression of the first SPDX line, or null."""
    found = F.trim(F.regexp_extract(text, SPDX, 1))
    return F.when(found != "", F.when(found.contains(" ") | found.contains("\t"), found).otherwise(F.regexp_replace(found, r"^\(*(.*?)(?:-only|-or-later|\+)?\)*$", "$1")))


@cache
def lookups() -> tuple[Lookup, Lookup]:
    return Lookup(Model(TEMPLATES, THRESHOLD)), Lookup(text_model())


def scan(files: DataFrame) -> DataFrame:
    """Adds license_own, own_score (six digits), file_license and file_score to rows with a column text. All of a row's own columns travel in one struct, so none can clash."""
    short, long = lookups()
    rows = files.select(F.struct(*(F.col(quoted(c)) for c in files.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"own": F.expr(_terms("text")), "spdx": spdx(F.col("text"))})
    rows = rows.select("row", "text", "spdx", F.expr(short.possible("own")).alias("short"), F.expr(long.possible("own")).alias("long"))
    # only a line, or a run of paragraphs, that can reach the threshold by itself is scored
    apart = lambda look, parts: f"array_max(transform(filter({parts}, u -> {_bind(_terms('u'), 'own', look.possible('own'))}), u -> {look.best('u', first[look])}))"
    first = {short: 0, long: len(short.model.names)}
    each = {
        "notice": f"case when short then {short.best('text')} end", "line": f"case when short then {apart(short, f'split(text, {chr(39)}{chr(92)}n{chr(39)})')} end",
        "full": f"case when long then {long.best('text', first[long])} end", "block": f"case when long then {apart(long, blocks('text'))} end",
    }
    names = F.array(*(F.lit(n) for n in [*short.model.names, *(x.split("/")[0] for x in long.model.names)]))
    name = lambda m: F.when(m.score.isNotNull(), F.element_at(names, 1 - m.place))
    marked = rows.withColumns({k: F.expr(x) for k, x in each.items()}).withColumn("file", F.greatest("notice", "full")).withColumn("best", F.greatest("file", "line", "block"))
    out = {"license_own": F.coalesce("spdx", name(F.col("best"))), "own_score": F.when(F.col("spdx").isNotNull(), 1.0).otherwise(F.col("best.score")), "file_license": name(F.col("file")), "file_score": F.col("file.score")}
    return marked.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in files.columns if c not in out), *(x.alias(c) for c, x in out.items()))


def ancestors(folder: Column) -> Column:
    """A directory and those above it, the root ('') last: one struct (depth, name) each."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("name")))


def inherit(scanned: DataFrame) -> DataFrame:
    """Adds folder, inherited, inherited_from and license (a file's own, else the nearest ancestor's) to scan()'s rows with a column path."""
    parts = F.filter(F.split(F.coalesce("path", F.lit("")), "/"), lambda x: x != "")
    rows = scanned.withColumn("folder", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    given = rows.where("file_license is not null").groupBy("folder").agg(F.min(F.struct((-F.col("file_score")).alias("down"), "file_license")).alias("best"))
    given = given.select(F.col("folder").alias("name"), F.col("best.file_license").alias("file_license"))
    above = rows.select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("up")).select("folder", "up.depth", "up.name")
    nearest = above.join(given, "name").groupBy("folder").agg(F.max(F.struct("depth", "name", "file_license")).alias("near"))
    nearest = nearest.select("folder", F.col("near.file_license").alias("inherited"), F.col("near.name").alias("inherited_from"))
    return rows.join(nearest, "folder", "left").withColumn("license", F.coalesce("license_own", "inherited"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/lang/hundreds of the id/id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    files = docs.select("doc_id", path.alias("path"), "text")
    return inherit(cut(scan(files).drop("text"), "scanned")).select("doc_id", "path", "license_own", "own_score", "file_license", "inherited", "inherited_from", "license")


def sql() -> str:
    """The query in DuckDB SQL: vectors by unnesting every line's and text's terms."""
    m = Model(TEMPLATES, THRESHOLD)
    weights = ", ".join(f"('{t}', {v})" for t, v in m.weight.items())
    vectors = ", ".join(f"({k}, '{n}', '{t}', {v}, CAST({m.norms[n]!r} AS DOUBLE))" for k, n in enumerate(m.names) for t, v in m.vectors[n].items())
    return f"""
WITH w(term, weight) AS (VALUES {weights}), v(k, name, term, value, norm) AS (VALUES {vectors}),
f AS (SELECT doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path,
             concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 100 AS VARCHAR)) AS folder, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, 0 AS line, text AS unit FROM f
      UNION ALL SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)), unnest(string_split(text, chr(10))) FROM f),
t AS (SELECT doc_id, line, term, count(*) AS n FROM (SELECT doc_id, line, unnest(string_split_regex(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+')) AS term FROM u) WHERE term <> '' AND term NOT IN ({_words(STOP)}) GROUP BY ALL),
l AS (SELECT doc_id, line, sqrt(sum(CAST(n * coalesce(weight, {m.other}) AS DOUBLE) * (n * coalesce(weight, {m.other})))) AS norm FROM t LEFT JOIN w USING (term) GROUP BY ALL),
d AS (SELECT doc_id, line, k, name, v.norm AS vnorm, sum(CAST(n * weight AS DOUBLE) * value) AS dot FROM t JOIN w USING (term) JOIN v USING (term) GROUP BY ALL),
s AS (SELECT doc_id, line, k, name, round(dot / (l.norm * vnorm), 6) AS score FROM d JOIN l USING (doc_id, line)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS r, row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, k) AS rl FROM s WHERE score >= {THRESHOLD}),
own AS (SELECT doc_id, name AS license_own, score AS own_score FROM b WHERE r = 1),
fil AS (SELECT doc_id, name AS file_license, score AS file_score FROM b WHERE line = 0 AND rl = 1),
g AS (SELECT folder AS name, file_license FROM (SELECT folder, file_license, row_number() OVER (PARTITION BY folder ORDER BY file_score DESC, file_license) AS r FROM f JOIN fil USING (doc_id)) WHERE r = 1),
a AS (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS depth FROM (SELECT DISTINCT folder FROM f)),
near AS (SELECT folder, file_license AS inherited, name AS inherited_from FROM
         (SELECT folder, file_license, name, row_number() OVER (PARTITION BY folder ORDER BY depth DESC) AS r
          FROM (SELECT folder, depth, array_to_string(list_slice(string_split(folder, '/'), 1, depth), '/') AS up FROM a) x JOIN g ON g.name = x.up) WHERE r = 1)
SELECT doc_id, path, license_own, own_score, file_license, inherited, inherited_from, coalesce(license_own, inherited) AS license
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN fil USING (doc_id) LEFT JOIN near USING (folder)
"""
