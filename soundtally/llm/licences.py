"""License scans: canonical digest lookup, in DataFrame operations only.

A text is canonical in lower case, without lines that state a copyright, with
every run of other characters than a-z and 0-9 made one space, and with one
spelling of words that have several. Its SHA-256 is joined with the digests of
known licences. A document is looked up as a whole, and each of its lines and of
its paragraphs too. The whole texts of common licences lie in ``licence_texts``.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as the same word.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "organisation": "organization",
    "organisations": "organizations",
    "favour": "favor",
    "recognise": "recognize",
    "authorised": "authorized",
    "merchantibility": "merchantability",
    "v2": "version 2",
    "v3": "version 3",
}
# Licence notices and texts as their stewards publish them.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}
# What a paragraph must name to stand for a long licence, parts of which other licences have too.
NAMED = {
    "Apache-2.0": ["apache license"],
    "GPL-2.0": ["gnu general public license", "version 2"],
    "GPL-3.0": ["gnu general public license", "version 3"],
    "LGPL-2.1": ["gnu lesser general public license", "version 2 1"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3"],
    "MPL-1.1": ["mozilla public license"],
    "MPL-2.0": ["mozilla public license"],
    "GFDL-1.3": ["gnu free documentation license", "version 1 3"],
    "CC0-1.0": ["cc0"],
    "CC-BY-SA-4.0": ["sharealike"],
    "OFL-1.1": ["sil open font license"],
}
# Headings of files that hold a short licence.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License"],
    "Zlib": ["zlib License", "The zlib License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
}
#: Words that a paragraph of a known text has at least, and a heading at most.
WORDS = 8
#: Lines of running text or list items that only begin like a copyright statement, where a text is wrapped there.
RUNNING = r"^\W*(copyright([,.;-]|ed|able|\W*$|\W+(like|if|also|resulting|the library|then|doctrine|exception|holder|owner|notice|law|licen[cs]e|statement|interest|and |or |in |on |to |of |for |is |as |that |which |treat|disclaim|permission|right|line))|\(c\) +[a-z])"
COPYRIGHT = r"^\W*(copyright|\(c\)|©|all rights reserved)"


def _spelt(c: Column) -> Column:
    """One spelling a word, on text between single spaces. Only texts with such a word are touched."""
    padded = F.concat(F.lit(" "), F.replace(c, F.lit(" "), F.lit("  ")), F.lit(" "))
    for word, to in SPELLINGS.items():
        padded = F.replace(padded, F.lit(f" {word} "), F.lit(f" {to} "))
    return F.trim(F.replace(padded, F.lit("  "), F.lit(" ")))


def canonical(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line."""
    low = F.lower(line)
    plain = F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))
    odd = "|".join(SPELLINGS)
    spelt = F.when(plain.rlike(rf"(^| )({odd})( |$)"), _spelt(plain)).otherwise(plain)
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(spelt)


def running(line: Column, c: Column) -> Column:
    """Canonical form c of one line, but not empty where the line belongs to a sentence."""
    again = F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))
    return F.when((c == "") & F.lower(line).rlike(RUNNING), _spelt(again)).otherwise(c)


def paragraphs(c: Column) -> Column:
    """Runs of lines that are not empty among canonical lines c, joined into one line each: (first, last, text)."""
    full = lambda i: F.coalesce(F.get(c, i) != "", F.lit(False))
    edge = lambda to: F.filter(F.transform(c, lambda x, i: F.when((x != "") & ~full(i + to), i)), lambda i: i.isNotNull())
    joined = F.array_join(F.transform(c, lambda x: F.when(x == "", F.lit("\n")).otherwise(x)), " ")
    texts = F.filter(F.transform(F.split(joined, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.arrays_zip(edge(-1).alias("first"), edge(1).alias("last"), texts.alias("text"))


def texts() -> dict[str, str]:
    """Whole licence texts by name."""
    files = [f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")]
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8").replace("<copyright notice>", "") for f in sorted(files, key=lambda f: f.name)}


def forms(name: str, text: str) -> list[str]:
    """A text with and without heading, list numbers and what follows its terms."""
    out = [text]
    if len(terms := re.split(r"\n\W*END OF TERMS AND CONDITIONS\W*\n", text, maxsplit=1)) == 2:
        out += [terms[0], f"{terms[0]}\nEND OF TERMS AND CONDITIONS"]
    for form in list(out):
        parts = re.split(r"\n\s*\n", form.strip())
        if name not in NAMED:
            out.append(re.sub(r"(?m)^\s*\d+\.\s", "", form))
        while len(parts) > 1 and (len(parts[0].split()) <= WORDS or re.match(COPYRIGHT, parts[0].lower())):
            parts = parts[1:]
            out.append("\n\n".join(parts))
            if name in TITLES:
                out.append(re.sub(r"(?m)^\s*\d+\.\s", "", out[-1]))
    bare = list(dict.fromkeys(out))
    return list(dict.fromkeys([*bare, *(f"{title}\n\n{form}" for title in TITLES.get(name, []) for form in bare)]))


def known(spark: SparkSession, texts_: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license) of known licence texts; as large as the table passed in, which is the constants of this module and the texts beside it by default.

    Of the texts beside it, paragraphs are known too where no other of these licences has them.
    """
    rows = [(k, t) for k, many in (texts_ or KNOWN).items() for t in many]
    df = spark.createDataFrame(rows, "license string, body string")
    noted = df.select(_digest(_whole(F.split("body", "\n"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))
    if texts_:
        return noted
    lined = lambda d: d.withColumn("l", F.split("body", "\n")).withColumn("c", F.transform("l", lambda x: running(x, canonical(x))))
    every = lined(spark.createDataFrame([(k, form) for k, t in texts().items() for form in forms(k, t)], "license string, body string"))
    wholes = every.select(_digest(F.array_join(F.filter("c", lambda x: x != ""), " ")).alias("digest"), "license")
    parts = lined(spark.createDataFrame([(k, t, NAMED.get(k, [])) for k, t in texts().items()], "license string, body string, named array<string>"))
    parts = parts.select("license", "named", F.explode(paragraphs(F.col("c"))["text"]).alias("p")).select("license", "named", F.explode(F.array("p", F.regexp_replace("p", "^[0-9]+ ", ""))).alias("p"))
    parts = parts.where((F.size(F.split("p", " ")) >= WORDS) & F.forall("named", lambda x: F.col("p").contains(x)))
    more = wholes.unionByName(parts.select(_digest(F.col("p")).alias("digest"), "license")).groupBy("digest").agg(F.min("license").alias("license"), F.max("license").alias("other"))
    return noted.unionByName(more.where("license = other").drop("other").join(noted, "digest", "left_anti"))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, canonical), lambda x: x != ""), " ")


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def scan(docs: DataFrame, licences: DataFrame | None = None) -> DataFrame:
    """doc_id, line_no, license: each line of docs (doc_id, text) that is a known licence text; line_no -1 for a whole document of several lines, and a paragraph's first line for one of several lines in a document of several paragraphs.

    A null, empty or blank text has none; nor has a row without doc_id. Rows that
    share a doc_id give each their own rows. An empty table gives an empty result.
    """
    found = known(docs.sparkSession) if licences is None else licences
    lines = docs.where("doc_id is not null").select("doc_id", F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x: F.struct(x.alias("l"), canonical(x).alias("c"))).alias("l"))
    canon = lines.select("doc_id", F.col("l.c").alias("c"), F.transform("l", lambda x: running(x["l"], x["c"])).alias("r"))
    canon = canon.select("doc_id", "c", "r", paragraphs(F.col("r")).alias("p"))
    full = F.filter("c", lambda x: x != "")
    units = F.concat(F.transform("c", lambda x, i: F.struct(i.alias("line_no"), F.when(x != "", _digest(x)).alias("digest"))), F.array(F.struct(F.lit(-1).alias("line_no"), F.when(F.size(full) > 1, _digest(F.array_join(full, " "))).alias("digest"))))
    wrapped = F.transform(F.filter("p", lambda p: (p["last"] > p["first"]) & (F.size("p") > 1)), lambda p: F.struct(p["first"].alias("line_no"), _digest(p["text"]).alias("digest")))
    other = F.array(F.struct(F.lit(-1).alias("line_no"), F.when((F.col("r") != F.col("c")) & (F.size("r") > 1), _digest(F.array_join(F.filter("r", lambda x: x != ""), " "))).alias("digest")))
    units = F.concat(units, wrapped, other)
    each = canon.select("doc_id", F.explode(F.filter(units, lambda u: u["digest"].isNotNull())).alias("u")).select("doc_id", "u.line_no", "u.digest")
    # a constant of this module, or what the caller chose to be small
    return each.join(F.broadcast(found), "digest").select("doc_id", "line_no", "license")


def oracle() -> str:
    """The same over documents in DuckDB."""

    def canon(c: str) -> str:
        spelt = f"' ' || replace(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ', '  ') || ' '"
        for word, to in SPELLINGS.items():
            spelt = f"replace({spelt}, ' {word} ', ' {to} ')"
        return f"case when regexp_matches(lower({c}), '{COPYRIGHT}') then '' else trim(replace({spelt}, '  ', ' ')) end"

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, many in KNOWN.items() for t in many)
    lines = f"list_transform(string_split(text, chr(10)), lambda x: {canon('x')})"
    whole = "array_to_string(list_filter(c, lambda x: x <> ''), ' ')"
    return f"""
    with k0(license, text) as (values {values}),
    k as (select sha256({whole}) as digest, min(license) as license from (select license, {lines} as c from k0) group by 1),
    d as (select doc_id, {lines} as c from documents where doc_id is not null and text is not null),
    u as (select doc_id, unnest(range(0, len(c))) as line_no, unnest(c) as t from d
          union all select doc_id, -1, {whole} from d where len(list_filter(c, lambda x: x <> '')) > 1)
    select doc_id, line_no::int as line_no, license from u join k on sha256(u.t) = k.digest where t <> ''
    """
