"""License scan: TF-IDF cosine of lines and whole files to templates, inherited by directory.

Built of DataFrame functions only. A line that speaks of licences is compared with every
template; so is the whole text of a file that has such a line. Words outside the templates'
vocabulary count together as one further dimension, as if no two were alike, so prose around a
licence lowers the cosine. A file is itself a licence file if its name says so, if its whole text is close to a template, or
if most of its words stand in licence lines.

A second step reads the files that so far have no licence: their words without regard to line
ends and comment marks, against the notices, SPDX lines, headers and licence files of
``license_texts``. Where a wording's phrase stands, as many words around it as the wording has are
compared with it by TF-IDF cosine, so other words of the line or the file do not count. Of equal
cosines the longer wording decides. ``duckdb_sql`` states both steps and the inheritance.

A file without a licence of its own takes that of
the nearest directory above it that has a licence file.

The best cosine decides, ties go to the alphabetically first licence. Null or empty texts have no
licence of their own, null paths inherit nothing. Null ids are carried along. Rows that repeat an
id, path and text are judged each, with the same result. Texts of any length are read whole. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backhaul.llm.license_texts import wordings
from backhaul.llm.scratch import Scratch

# Licence identifiers with the customary wording of their notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial "
                     "4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without "
            "restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. "
                "2.0."),
]
#: A line or file without any of these (in lower case) speaks of no licence.
CUES = ["licen", "copyright", "spdx", "redistribut", "permission is hereby"]
#: Further ones of the second step.
MORE_CUES = ["gpl", "creative commons", "public domain", "provided 'as-is'"]
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([._-][^/]*)?$"
#: Stands for all words outside the templates.
OTHER = "*"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def has_cue(text: Column, cues: list[str] = CUES) -> Column:
    low = F.lower(text)
    found = F.contains(low, F.lit(cues[0]))
    for cue in cues[1:]:
        found = found | F.contains(low, F.lit(cue))
    return found


def template_terms(spark: SparkSession, templates=None) -> tuple[DataFrame, DataFrame]:
    """Unit weights by (license, template, term), and idf by term. As many rows as templates
    have words."""
    given = templates or TEMPLATES
    rows = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"),
                 F.lit(text).alias("text")) for i, (name, text) in enumerate(given)])))
    counts = (rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term"))
              .groupBy("template", "license", "term").agg(F.count("*").alias("tf")))
    n = float(len(given))
    idf = counts.groupBy("term").agg(
        (F.log((1 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    weighted = counts.join(idf, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template")))
    return weighted.withColumn("weight", F.col("weight") / norm).drop("tf", "idf"), idf


def best_template(units: DataFrame, unit: list[str], weights: DataFrame, idf: DataFrame,
                  n_templates: int) -> DataFrame:
    """``unit`` columns with ``license`` and ``score`` of the closest template, for units that
    share a word with one. ``units`` has a column ``text``."""
    words = units.select(*unit, F.explode(terms(F.col("text"))).alias("term"))
    # the templates' vocabulary has a fixed size
    known = (words.join(F.broadcast(idf), "term", "left")
             .select(*unit, F.when(F.col("idf").isNull(), OTHER).otherwise(F.col("term"))
                     .alias("term"),
                     F.coalesce("idf", F.log(F.lit(1.0 + n_templates)) + 1).alias("idf"))
             .groupBy(*unit, "term").agg(
                 (F.when(F.col("term") == OTHER, F.sqrt(F.count("*"))).otherwise(F.count("*"))
                  * F.max("idf")).alias("value")))
    return (known.join(F.broadcast(weights), "term")
            .groupBy(*unit, "template", "license")
            .agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
            .join(known.groupBy(*unit).agg(
                F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")), unit)
            .withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
            .groupBy(*unit).agg(F.min(F.struct((-F.col("score")).alias("rank"), "license"))
                                .alias("best"))
            .select(*unit, F.col("best.license").alias("license"),
                    (-F.col("best.rank")).alias("score")))


def wording_terms(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The wordings by phrase, and one row with idf by word."""
    given = wordings()
    rows = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(text).alias("text"),
                 F.lit("|".join(phrases)).alias("phrases"), F.lit(only).alias("only_file"))
        for name, phrases, text, only in given])))
    rows = (rows.withColumn("words", terms(F.col("text")))
            .withColumn("phrases", F.split("phrases", r"\|"))
            .withColumn("phrase", F.element_at("phrases", 1))
            .withColumn("plain", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
            # the words before the phrase
            .withColumn("before", F.size(terms(F.expr(
                "substring_index(plain, concat(' ', phrase, ' '), 1)"))))
            .withColumn("n", F.size("words")).withColumnRenamed("words", "bag")
            .withColumn("words", F.array_distinct("bag")))
    n = float(len(given))
    idf = (rows.select(F.explode("words").alias("term")).groupBy("term")
           .agg((F.log((1 + n) / (1 + F.count("*"))) + 1).alias("idf"))
           .agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf")))
    return rows.select("license", "phrase", "phrases", "before", "n", "bag", "words",
                       "only_file"), idf


def best_wording(files: DataFrame, given: DataFrame, idf: DataFrame, threshold: float,
                 file_share: float) -> DataFrame:
    """``file``, ``path``, ``license``, ``score`` and ``is_file`` of files that hold a wording."""
    widest = given.agg(F.max("before").alias("most_before"), F.max("n").alias("most"))
    # tables of a fixed size
    phrases = F.broadcast(given.select("phrase").distinct().crossJoin(widest))
    here = (files.select("file", "path", terms(F.col("text")).alias("own"))
            .withColumn("plain", F.concat(F.lit(" "), F.array_join("own", " "), F.lit(" ")))
            .join(phrases, F.expr("contains(plain, concat(' ', phrase, ' '))"))
            .withColumn("first", F.split("phrase", " "))
            .withColumn("total", F.size("own"))
            .withColumn("places", F.expr(
                "filter(sequence(1, total), i -> own[i - 1] = first[0]"
                " AND slice(own, i, size(first)) = first)"))
            .select("file", "path", "phrase", "total", F.expr(
                "inline(transform(places, i -> struct(least(i - 1, most_before) AS lead, "
                "slice(own, greatest(i - most_before, 1), most_before + most) AS around)))")))
    weight = "coalesce(idf[x], log({n} + 1D) + 1)"
    unknown = weight.format(n=float(len(wordings())))

    def count(bag: str) -> str:
        return f"size(filter({bag}, y -> y = x))"

    def product(words: str, a: str, b: str) -> str:
        """Sum over words of the weights, counts times idf, in two bags."""
        return (f"aggregate({words}, 0D, (s, x) -> s + {count(a)} * {count(b)} * {unknown} "
                f"* {unknown})")

    scored = (here.join(F.broadcast(given), "phrase").crossJoin(F.broadcast(idf))
              .withColumn("cut", F.expr("slice(around, greatest(lead - before, 0) + 1, "
                                        "n - greatest(before - lead, 0))"))
              .withColumn("text", F.concat(F.lit(" "), F.array_join("cut", " "), F.lit(" ")))
              .filter("forall(phrases, p -> contains(text, concat(' ', p, ' ')))")
              .withColumn("seen", F.array_distinct("cut"))
              .withColumn("score", F.expr(
                  f"round({product('array_intersect(seen, words)', 'cut', 'bag')} / "
                  f"sqrt({product('seen', 'cut', 'cut')} * {product('words', 'bag', 'bag')}), 6)"))
              .filter(F.col("score") >= threshold))
    best = scored.groupBy("file").agg(
        F.min(F.struct((-F.col("score")).alias("rank"), (-F.col("n")).alias("shorter"), "license",
                       "path")).alias("best"),
        F.max(F.col("only_file") | (F.col("n") >= file_share * F.col("total"))).alias("most"))
    return best.select("file", "best.path", "best.license", (-F.col("best.rank")).alias("score"),
                       (F.col("most") | F.coalesce(F.col("best.path").rlike(LICENCE_FILE), F.lit(False)))
                       .alias("is_file"))


def scan(rows: DataFrame, threshold: float = 0.75, file_share: float = 0.5,
         id_column: str = "doc_id", path_column: str = "path", text_column: str = "text",
         templates=None) -> DataFrame:
    """Per row: the id and path, ``license``, ``score`` and ``origin`` (header, file, inherited),
    and the ``license_dir`` it was inherited from; nulls where there is none.

    Given ``templates`` are all that is looked for.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "licenses")
    weights, idf = (scratch.keep(t.coalesce(1)) for t in template_terms(spark, templates))
    n = len(templates or TEMPLATES)
    files = rows.select(F.col(id_column).alias("id"), F.col(path_column).alias("path"),
                        F.col(text_column).alias("text"))
    # ids and paths may be null or repeat, joins want one value that does not
    files = files.withColumn("file", F.md5(F.concat_ws(
        "\0", F.hex(F.col("id").cast("string")), F.col("id").isNull().cast("string"),
        F.hex("path"), F.col("path").isNull().cast("string"), F.md5("text"))))
    # read several times below; texts that speak of licences are few
    speaking = scratch.keep(files.filter(has_cue(F.col("text"))).dropDuplicates(["file"]))
    lines = scratch.keep(
        speaking.select("file", F.posexplode(F.split("text", "\n")).alias("line", "text"))
        .filter(has_cue(F.col("text"))))
    headers = scratch.keep(
        best_template(lines, ["file", "line"], weights, idf, n)
        .filter(F.col("score") >= threshold)
        .join(lines.select("file", "line", F.size(terms(F.col("text"))).alias("n")),
              ["file", "line"])
        .groupBy("file").agg(
            F.min(F.struct((-F.col("score")).alias("rank"), "license")).alias("best"),
            F.sum("n").alias("words")))
    whole = scratch.keep(best_template(speaking, ["file"], weights, idf, n).select(
        "file", F.col("license").alias("file_license"), F.col("score").alias("file_score")))
    judged = scratch.keep(speaking.select("file", "path", F.size(terms(F.col("text"))).alias("n"))
              .join(whole, "file", "left").join(headers, "file", "left")
              .withColumn("close", F.coalesce(F.col("file_score") >= threshold, F.lit(False)))
              .select("file", "path",
                      F.when(F.col("close"), F.col("file_license"))
                      .otherwise(F.col("best.license")).alias("license"),
                      F.when(F.col("close"), F.col("file_score"))
                      .otherwise(-F.col("best.rank")).alias("score"),
                      (F.col("close") | F.coalesce(F.col("words") >= file_share * F.col("n"),
                                                   F.lit(False))
                       | F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)))
                      .alias("is_file"))
              .filter("license IS NOT NULL"))
    if templates is None:
        given, words = (scratch.keep(t.coalesce(1)) for t in wording_terms(spark))
        silent = scratch.keep(files.filter(has_cue(F.col("text"), CUES + MORE_CUES))
                              .dropDuplicates(["file"])
                              .join(judged.select("file"), "file", "left_anti"))
        judged = scratch.keep(judged.unionByName(
            best_wording(silent, given, words, threshold, file_share)))
    own = scratch.keep(judged.groupBy("file").agg(
        F.min(F.struct((-F.col("score")).alias("rank"), "license")).alias("best"),
        F.max("is_file").alias("is_file")))

    def parent(path: Column) -> Column:
        return F.regexp_replace(path, "/?[^/]*$", "")

    granting = (judged.filter("is_file AND path IS NOT NULL").groupBy(parent(F.col("path")).alias("up"))
                .agg(F.min(F.struct((-F.col("score")).alias("rank"), "license")).alias("grant")))
    # nearest grant once per directory, not per file
    names = F.split("dir", "/")
    above = (files.filter("path IS NOT NULL").select(parent(F.col("path")).alias("dir")).distinct()
             .select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(
                 F.sequence(F.lit(0), F.size(names)))).alias("depth"))
             .withColumn("up", F.array_join(F.slice(names, F.lit(1), F.col("depth")), "/")))
    nearest = scratch.keep(above.join(granting, "up").groupBy("dir")
                           .agg(F.max(F.struct("depth", "up", "grant")).alias("near"))
                           .select("dir", "near.up", "near.grant"))
    everything = (files.select("file", "id", "path")
                  .withColumn("dir", parent(F.col("path")))
                  .join(own, "file", "left").join(nearest, "dir", "left"))
    mine = F.col("best").isNotNull()
    return everything.select(
        F.col("id").alias(id_column), F.col("path").alias(path_column),
        F.when(mine, F.col("best.license")).otherwise(F.col("grant.license")).alias("license"),
        F.when(mine, -F.col("best.rank")).otherwise(-F.col("grant.rank")).alias("score"),
        F.when(mine, F.when(F.col("is_file"), "file").otherwise("header"))
        .when(F.col("grant").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("up")).alias("license_dir"))


def duckdb_sql(documents: str, path_sql: str, threshold: float = 0.75, file_share: float = 0.5
               ) -> str:
    """The same scan of ``documents`` (doc_id, text), with paths by ``path_sql``, for DuckDB."""
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''"))
                       for i, (name, text) in enumerate(TEMPLATES))
    cue = " OR ".join(f"contains(lower(text), '{c}')" for c in CUES)
    name = LICENCE_FILE.replace("(?i)", "")

    def best(units: str, unit: str) -> str:
        return f"""
        (SELECT {unit}, license, score FROM (
          SELECT {unit}, license, score,
                 row_number() OVER (PARTITION BY {unit} ORDER BY score DESC, license) AS place
          FROM (SELECT {", ".join("k." + u.strip() for u in unit.split(","))}, template, license,
                       round(sum(value * weight) / max(norm), 6) AS score
                FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY {unit})) AS norm FROM (
                        SELECT {unit}, coalesce(i.term, '{OTHER}') AS term,
                               CASE WHEN max(coalesce(i.term, '{OTHER}')) = '{OTHER}' THEN sqrt(count(*))
                                    ELSE count(*) END * max(coalesce(idf, ln(1.0 + (SELECT count(*) FROM tpl)) + 1)) AS value
                        FROM (SELECT {unit}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term
                              FROM {units}) t LEFT JOIN idf i USING (term) GROUP BY ALL)) k
                JOIN weights USING (term) GROUP BY ALL)) WHERE place = 1)"""

    rows = ", ".join("({}, '{}', '{}', '{}', {})".format(
        i, name, text.replace("'", "''"), "|".join(phrases), only)
        for i, (name, phrases, text, only) in enumerate(wordings()))
    more = " OR ".join(f"contains(lower(text), '{c}')".replace("'as-is'", "''as-is''")
                       for c in CUES + MORE_CUES)
    unknown = f"(ln({float(len(wordings()))} + 1) + 1)"
    second = f"""given AS (
      SELECT w, license, phrases[1] AS phrase, phrases, bag, len(bag) AS n, only_file,
             len(regexp_extract_all(split_part(' ' || array_to_string(bag, ' ') || ' ',
                                               ' ' || phrases[1] || ' ', 1), '[a-z0-9]+')) AS before
      FROM (SELECT w, license, string_split(phrases, '|') AS phrases, only_file,
                   regexp_extract_all(lower(text), '[a-z0-9]+') AS bag
            FROM (VALUES {rows}) v(w, license, text, phrases, only_file))),
    bags AS (SELECT w, term, count(*) AS tf FROM (SELECT w, unnest(bag) AS term FROM given)
             GROUP BY ALL),
    rarity AS (SELECT term, ln((1 + (SELECT count(*) FROM given)::DOUBLE) / (1 + count(*))) + 1 AS idf
               FROM bags GROUP BY term),
    wide AS (SELECT max(before) AS most_before, max(n) AS most FROM given),
    silent AS (SELECT doc_id, path, own, len(own) AS total,
                      ' ' || array_to_string(own, ' ') || ' ' AS plain
               FROM (SELECT doc_id, path, regexp_extract_all(lower(text), '[a-z0-9]+') AS own
                     FROM files WHERE {more})
               WHERE doc_id NOT IN (SELECT doc_id FROM judged)),
    places AS (SELECT doc_id, path, own, total, w, license, phrases, n, before, only_file,
                      unnest(list_filter(range(1, total + 1), lambda i:
                             own[i:i + len(string_split(phrase, ' ')) - 1]
                               = string_split(phrase, ' '))) AS i
               FROM silent JOIN given ON contains(plain, ' ' || phrase || ' ')),
    cuts AS (SELECT *, row_number() OVER () AS c,
                    own[first:least(first + n - greatest(before - lead, 0) - 1,
                                    base + most_before + most - 1)] AS cut
             FROM (SELECT *, base + greatest(lead - before, 0) AS first
                   FROM (SELECT *, greatest(i - most_before, 1) AS base,
                                least(i - 1, most_before) AS lead FROM places, wide))),
    fits AS (SELECT * FROM cuts WHERE len(list_filter(phrases, lambda p: NOT contains(
               ' ' || array_to_string(cut, ' ') || ' ', ' ' || p || ' '))) = 0),
    cut_bags AS (SELECT c, w, term, count(*) AS tf
                 FROM (SELECT c, w, unnest(cut) AS term FROM fits) GROUP BY ALL),
    cosines AS (
      SELECT a.c, round(sum(a.tf * coalesce(b.tf, 0) * coalesce(idf, {unknown}) ** 2)
                        / sqrt(sum((a.tf * coalesce(idf, {unknown})) ** 2)
                               * any_value(m.square)), 6) AS score
      FROM cut_bags a LEFT JOIN bags b ON b.w = a.w AND b.term = a.term
      LEFT JOIN rarity r ON r.term = a.term
      JOIN (SELECT w, sum((tf * idf) ** 2) AS square FROM bags JOIN rarity USING (term)
            GROUP BY w) m ON m.w = a.w
      GROUP BY a.c),
    worded AS (
      SELECT doc_id, path, license, score,
             bool_or(only_file OR n >= {file_share} * total) OVER (PARTITION BY doc_id)
               OR coalesce(regexp_matches(lower(path), '{name}'), false) AS is_file
      FROM fits JOIN cosines USING (c) WHERE score >= {threshold}
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, n DESC, license) = 1),"""

    return f"""
    WITH tpl(template, license, text) AS (VALUES {values}),
    tf AS (SELECT template, license, term, count(*) AS tf FROM (
             SELECT template, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term
             FROM tpl) GROUP BY ALL),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 AS idf
            FROM tf GROUP BY term),
    weights AS (SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf)
                       OVER (PARTITION BY template)) AS weight FROM tf JOIN idf USING (term)),
    files AS (SELECT doc_id, {path_sql} AS path, text FROM {documents}),
    speaking AS (SELECT * FROM files WHERE {cue}),
    lines AS (SELECT * FROM (
                SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line,
                       unnest(string_split(text, chr(10))) AS text FROM speaking)
              WHERE {cue}),
    headers AS (SELECT doc_id, arg_min(license, (-score, license)) AS license, max(score) AS score,
                       sum(n) AS words
                FROM {best("lines", "doc_id, line")} JOIN (
                  SELECT doc_id, line, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n
                  FROM lines) USING (doc_id, line)
                WHERE score >= {threshold} GROUP BY doc_id),
    judged AS (SELECT s.doc_id, s.path,
                   CASE WHEN w.score >= {threshold} THEN w.license ELSE h.license END AS license,
                   CASE WHEN w.score >= {threshold} THEN w.score ELSE h.score END AS score,
                   coalesce(w.score >= {threshold}, false)
                     OR coalesce(words >= {file_share} * len(regexp_extract_all(lower(text), '[a-z0-9]+')), false)
                     OR regexp_matches(lower(path), '{name}') AS is_file
            FROM speaking s LEFT JOIN {best("speaking", "doc_id")} w ON w.doc_id = s.doc_id
            LEFT JOIN headers h ON h.doc_id = s.doc_id
            WHERE CASE WHEN w.score >= {threshold} THEN w.license ELSE h.license END IS NOT NULL),
    {second}
    own AS (FROM judged UNION ALL FROM worded),
    granting AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS up,
                        arg_min(license, (-score, license)) AS license, max(score) AS score
                 FROM own WHERE is_file GROUP BY 1),
    placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
    nearest AS (SELECT * FROM (
                  SELECT d.dir, g.*, row_number() OVER (PARTITION BY d.dir ORDER BY length(g.up) DESC) AS place
                  FROM (SELECT DISTINCT dir FROM placed) d
                  JOIN granting g ON g.up = '' OR d.dir = g.up OR starts_with(d.dir, g.up || '/'))
                WHERE place = 1)
    SELECT p.doc_id, p.path, coalesce(o.license, n.license) AS license,
           CASE WHEN o.license IS NOT NULL THEN o.score ELSE n.score END AS score,
           CASE WHEN o.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END
                WHEN n.license IS NOT NULL THEN 'inherited' END AS origin,
           CASE WHEN o.license IS NULL THEN n.up END AS license_dir
    FROM placed p LEFT JOIN own o ON o.doc_id = p.doc_id LEFT JOIN nearest n ON n.dir = p.dir"""
