"""Licence scans (DataFrame functions and Spark ML only).

A paragraph is a line with a word. A notice wrapped over lines is found in joins of neighbouring
lines that no blank line parts: up to JOINED_LINES of them, and the whole run. A multinomial logistic regression over sparse word n-grams
(one to three words) names a licence family or "unknown"; it is fitted on template sentences in
varied surroundings and, for the unknown class, on fixed sentences and on lines of the corpus that
hold a cue word but resemble no template. Probabilities are calibrated by a temperature: a first fit
leaves out whole templates, sentences and lines, the temperature is what makes these unseen rows
likeliest, and the final fit is on all rows. A prediction is confirmed if, of the templates of all families, the one
that matches most of the paragraph is of the predicted family. An index by rare bigrams names all templates that can reach
their least share; it leaves none out.

Only n-grams with a cue word (licence, copyright, the names of families, ...) are features. A
paragraph without one has no features, so its answer is the intercept's - unknown - and it is
never exploded: one pattern per text keeps the scan narrow.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, let, materialize, read

UNKNOWN = "unknown"
#: Licence families by full names, short names, SPDX ids, and sentences of their texts and headers. Digits
#: stand for any.
FAMILIES = {
    "agpl": (["gnu affero general public license"], ["agpl", "agplv3", "agpl 3.0"], ["agpl-3.0"], ["under the terms of the gnu affero general public license as published by the free software foundation"]),
    "apache": (["apache license", "apache software license"], ["apache 2.0"], ["apache-2.0"], ["you may not use this file except in compliance with the license", "licensed to the apache software foundation under one or more contributor license agreements", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"]),
    "artistic": (["artistic license"], ["artistic 2.0"], ["artistic-2.0"], ["under the same terms as perl itself under the artistic license"]),
    "boost": (["boost software license"], ["bsl 1.0"], ["bsl-1.0"], ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"]),
    "bsd": (["bsd license", "bsd 3-clause license", "bsd-style license", "new bsd license"], ["bsd", "bsd 3-clause"], ["bsd-3-clause", "bsd-2-clause"], ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"]),
    "cc0": (["creative commons zero license", "cc0 license"], ["cc0"], ["cc0-1.0"], ["dedicated to the public domain under cc0 1.0", "cc0 1.0 universal", "has waived all copyright and related rights under cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "creativecommons org publicdomain zero 1.0"]),
    "cc-by": (["creative commons attribution 4.0 international license", "creative commons attribution license"], ["cc by 4.0", "cc by"], ["cc-by-4.0"], ["creativecommons org licenses by 4.0"]),
    "cc-by-nc": (["creative commons attribution-noncommercial 4.0 international license", "creative commons attribution-noncommercial license"], ["cc by-nc 4.0", "cc by-nc"], ["cc-by-nc-4.0"], ["creativecommons org licenses by nc 4.0"]),
    "cc-by-nc-nd": (["creative commons attribution-noncommercial-noderivatives 4.0 international license"], ["cc by-nc-nd 4.0", "cc by-nc-nd"], ["cc-by-nc-nd-4.0"], ["creativecommons org licenses by nc nd 4.0"]),
    "cc-by-nc-sa": (["creative commons attribution-noncommercial-sharealike 4.0 international license"], ["cc by-nc-sa 4.0", "cc by-nc-sa"], ["cc-by-nc-sa-4.0"], ["creativecommons org licenses by nc sa 4.0"]),
    "cc-by-nd": (["creative commons attribution-noderivatives 4.0 international license"], ["cc by-nd 4.0", "cc by-nd"], ["cc-by-nd-4.0"], ["creativecommons org licenses by nd 4.0"]),
    "cc-by-sa": (["creative commons attribution-sharealike 4.0 international license", "creative commons attribution-sharealike license"], ["cc by-sa 4.0", "cc by-sa"], ["cc-by-sa-4.0"], ["creativecommons org licenses by sa 4.0"]),
    "cddl": (["common development and distribution license"], ["cddl"], ["cddl-1.0"], ["the contents of this file are subject to the terms of the common development and distribution license"]),
    "epl": (["eclipse public license"], ["epl 2.0"], ["epl-2.0"], ["this program and the accompanying materials are made available under the terms of the eclipse public license"]),
    "eupl": (["european union public licence", "european union public license"], ["eupl"], ["eupl-1.2"], ["you may not use this work except in compliance with the licence you may obtain a copy of the eupl licence"]),
    "gfdl": (["gnu free documentation license"], ["gfdl"], ["gfdl-1.3"], ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"]),
    "gpl": (["gnu general public license", "gnu gpl"], ["gpl", "gplv3", "gpl 3.0"], ["gpl-3.0", "gpl-2.0"], ["under the terms of the gnu general public license as published by the free software foundation", "you should have received a copy of the gnu general public license along with this program"]),
    "isc": (["isc license"], ["isc"], ["isc"], ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    "lgpl": (["gnu lesser general public license", "gnu library general public license"], ["lgpl", "lgplv3", "lgpl 2.1"], ["lgpl-2.1", "lgpl-3.0"], ["under the terms of the gnu lesser general public license as published by the free software foundation"]),
    "mit": (["mit license", "mit licence", "expat license"], ["mit"], ["mit"], ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"]),
    "mpl": (["mozilla public license"], ["mpl 2.0"], ["mpl-2.0"], ["this source code form is subject to the terms of the mozilla public license v. 2.0"]),
    "ms-pl": (["microsoft public license"], ["ms-pl"], ["ms-pl"], []),
    "odbl": (["open database license", "open data commons open database license"], ["odbl"], ["odbl-1.0"], ["this database is made available under the open database license"]),
    "ofl": (["sil open font license"], ["ofl 1.1"], ["ofl-1.1"], ["this font software is licensed under the sil open font license"]),
    "php": (["php license"], ["php 3.01"], ["php-3.01"], ["this source file is subject to version 3.01 of the php license"]),
    "postgresql": (["postgresql license"], [], ["postgresql"], []),
    "proprietary": ([], [], [], ["all rights reserved", "todos los derechos reservados", "tous droits réservés", "alle rechte vorbehalten", "copyright 2024 all rights reserved", "no part of this publication may be reproduced without permission of the copyright holder", "proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited"]),
    "psf": (["python software foundation license"], ["psf"], ["psf-2.0"], []),
    "public-domain": ([], [], [], ["this work is in the public domain", "released into the public domain by its author", "placed in the public domain by the author"]),
    "unlicense": (["unlicense"], [], ["unlicense"], ["this is free and unencumbered software released into the public domain"]),
    "upl": (["universal permissive license"], ["upl 1.0"], ["upl-1.0"], []),
    "wtfpl": (["do what the fuck you want to public license"], ["wtfpl"], ["wtfpl"], ["this program is free software it comes without any warranty under the terms of the do what the fuck you want to public license"]),
    "zlib": (["zlib license", "zlib libpng license"], ["zlib"], ["zlib"], ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"]),
}
#: Ways to state a licence by its name, by a short name, and by an id; each name takes some of them in turn.
BY_NAME = ("licensed under the {}", "released under the {}", "distributed under the terms of the {}", "available under the {} version 3", "covered by the {}", "published under {}", "subject to the {}")
BY_SHORT = ("licensed under {}", "licensed under the {}", "released under the {} license", "the {} license", "license file {}", "license {}", "under {} licence")
BY_ID = ("spdx-license-identifier: {}",)


def _made(family: str) -> list[str]:
    """The templates of a family: its sentences, each name alone and in three wordings, each short name in all, each id."""
    names, shorts, ids, sentences = FAMILIES[family]
    start = sorted(FAMILIES).index(family)
    turn = lambda forms, k, n: [forms[(start + k + j) % len(forms)] for j in range(n)]
    out = [*sentences, *[i.format(x) for x in ids for i in BY_ID]]
    out += [form.format(n) for k, n in enumerate(names) for form in turn(BY_NAME, k, 3)] + [n for n in names if " " in n]
    out += [form.format(x) for x in shorts for form in BY_SHORT]
    return list(dict.fromkeys(out))


#: Notices by which works state their licence, by family.
TEMPLATES = {family: _made(family) for family in FAMILIES}
#: Sentences with cue words that state no licence.
OTHER_SENTENCES = [
    "he lost his driving license last year", "the council granted permission to enter the building", "she studied at mit before the war",
    "the apache helicopter landed at noon", "the public domain of the city is wide", "our warranty covers parts and labour",
    "the rights of the workers were discussed", "a gnu is a large antelope", "license plates are made of metal", "the commons voted in the evening",
    "attribution of the painting is disputed", "the fishing license costs ten euros", "copyright law is a subject of debate", "redistribution of wealth was the topic",
    "they were licensed to sell food", "the bsd conference is in may", "permission was refused",
    "the restaurant has a license to serve wine", "a general public meeting on the license was held", "the software license costs more each year", "all rights of way are kept open", "the artistic director has no license",
    "the seats are reserved for members", "a license under review by the ministry", "the eclipse was seen by the public", "the union licensed its songs to the studio", "the board reserved its decision on the license",
    "the mozilla festival takes place in spring", "free software is a matter of permission and trust", "the zlib author gave a talk on his license", "a font is licensed by its maker", "the database was opened without permission",
    "she renewed her licence and reserved a table", "the terms of the license were not disclosed", "under the old license the mine could not open", "the public license office is closed", "this license is not transferable says the shop",
    "rights reserved for the first two rows", "the documentation says nothing of copyright", "creative people met on the commons", "the patent was licensed to a boost converter firm", "the domain name was sold", "permission slips are due on friday",
]
#: Words (the first with any ending) without which a paragraph states no licence.
_CUE = r"^(?:(?:un)?licen[sc]\w*|lizenz\w*|copyright\w*|spdx|a?l?gpl\w*|gnu|mit|apache|bsd|cc9?|mozilla|mpl|isc|zlib|wtfpl|eupl|gfdl|odbl|cddl|ofl|epl|creative|creativecommons|commons|attribution|noncommercial|sharealike|noderivatives|nc|nd|sa|unencumbered|permission|permitted|redistribution|rights|reserved|domain|warranty|derechos|reservados|droits|réservés|rechte|vorbehalten)$"
_STRONG = r"(?:un)?licen[sc]|lizenz|copyright|spdx|[al]?gpl|cc0|mozilla|permission|redistribution|rights|reserved|domain|derechos|droits|vorbehalten"
_GATE = rf"(?i)(?<![a-z0-9])(?:{_STRONG}|creative|commons|permitted|warranty|reservados|réservés|(?:gnu|mit|apache|bsd|cc|mpl|isc|rechte)(?![a-z]))"
#: Every template has one of these, so joined lines without one are no notice.
_NOTICE = rf"(?i)(?<![a-z0-9])(?:{_STRONG})"
#: Neighbouring lines that are read as one, besides a whole run.
JOINED_LINES = 4
#: Lines of the corpus with a cue word that may teach the unknown class, at most.
SAMPLE_LINES = 2000
#: N-grams that the regression may have; the templates and the sample have fewer, so none is left out.
VOCABULARY = 1 << 18
#: Share of a template's bigrams from which a corpus line does not teach the unknown class.
LIKE_TEMPLATE = 0.5
#: Least calibrated probability of a family, and least share of a template's bigrams.
MIN_PROBABILITY, MIN_TEMPLATE = 0.5, 0.8
#: A template of fewer bigrams confirms only in a paragraph of at most so many words, or one that has a word of licensing.
SHORT_BIGRAMS, SHORT_WORDS = 3, 14
LICENSING = ("copyright", "c", "spdx", "licensed", "released", "distributed", "governed", "covered", "published", "subject", "terms", "available", "under")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; numbers become 9, so versions do not matter."""
    plain = F.regexp_replace(F.lower(text), r"[0-9]+(?:\.[0-9]+)*", "9")
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _ngrams(words: Column, n: int) -> Column:
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def features(words: Column) -> Column:
    """One to three words that include a cue word; each word is tested once."""

    def grams(cued: Column, n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        near = F.filter(at, lambda i: F.array_contains(F.slice(cued, i, n), True))
        return F.transform(near, lambda i: F.array_join(F.slice(words, i, n), " "))

    cued = F.transform(words, lambda w: w.rlike(_CUE))
    return let(cued, lambda c: F.concat(*(grams(c, n) for n in (1, 2, 3))))


def _templates(spark: SparkSession) -> DataFrame:
    """family, template, and whether it is the last of several in its family."""
    rows = [(f, t, len(ts) > 1 and i == len(ts) - 1) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "family string, template string, unseen boolean").coalesce(1)


def _templates_with_bigrams(spark: SparkSession) -> DataFrame:
    t = _templates(spark).withColumn("words", tokens(F.col("template")))
    return t.select("family", F.array_distinct(_ngrams(F.col("words"), 2)).alias("bigrams")).where(F.size("bigrams") > 0).distinct()


def _indexed(templates: DataFrame) -> DataFrame:
    """One row: templates (all, array of family and bigrams) and keys (array of bigram and the places of templates). A template
    of which MIN_TEMPLATE stands in a text lacks at most the rest of its bigrams, so it has one of any that are one more than
    these: its rarest are its keys."""
    every = templates.agg(F.sort_array(F.collect_list(F.struct("family", "bigrams"))).alias("templates"))
    held = every.select(F.posexplode("templates").alias("id", "t")).select("id", F.size("t.bigrams").alias("size"), F.explode("t.bigrams").alias("b"))
    rare = F.row_number().over(Window.partitionBy("id").orderBy("n", "b"))
    held = held.join(held.groupBy("b").agg(F.count("*").alias("n")), "b").withColumn("r", rare)
    lacking = F.col("size") - F.ceil(F.col("size") * MIN_TEMPLATE - 1e-9)
    keys = held.where(F.col("r") <= lacking + 1).groupBy(F.col("b").alias("key")).agg(F.collect_list("id").alias("ids"))
    return every.crossJoin(keys.agg(F.collect_list(F.struct("key", "ids")).alias("keys"))).coalesce(1)  # one row each, of fixed size


def best_template(words: Column, templates: Column, keys: Column) -> Column:
    """struct(matched, share, family) of the template that holds most bigrams of the words, of those of all families of which
    at least MIN_TEMPLATE stands there; null for none. So a longer notice wins over one that is a part of it."""
    brief = (F.size(words) <= SHORT_WORDS) | F.exists(words, lambda w: w.isin(*LICENSING))

    def near(own: Column) -> Column:
        there = F.array_intersect(own, keys["key"])
        ids = let(there, lambda th: F.flatten(F.transform(F.filter(keys, lambda k: F.array_contains(th, k["key"])), lambda k: k["ids"])))
        return F.transform(F.array_distinct(ids), lambda i: F.get(templates, i))

    def pick(own: Column) -> Column:
        held = F.transform(near(own), lambda t: let(F.size(F.array_intersect(t["bigrams"], own)), lambda n: F.struct(n.alias("matched"), (n / F.size(t["bigrams"])).alias("share"), t["family"].alias("family"))))
        return F.array_max(F.filter(held, lambda h: (h["share"] >= MIN_TEMPLATE) & (brief | (h["matched"] >= SHORT_BIGRAMS))))

    return let(_ngrams(words, 2), pick)


def template_share(words: Column, known: Column) -> Column:
    """Greatest share of a template's bigrams that the words hold; known is an array of bigram arrays."""
    return let(_ngrams(words, 2), lambda own: F.array_max(F.transform(known, lambda t: F.size(F.array_intersect(t, own)) / F.size(t))))


def training_rows(spark: SparkSession, plain: DataFrame, cued: DataFrame, templates: DataFrame) -> DataFrame:
    """family, words, unseen: template sentences alone and inside lines of the corpus, other sentences, and
    lines of the corpus with a cue word that are like no template. plain and cued: line."""
    ends = plain.select(F.substring_index("line", " ", 6).alias("before"), F.substring_index("line", " ", -6).alias("after")).distinct()
    first = ends.orderBy(F.xxhash64("before", "after"), "before", "after").limit(8).collect()
    around = [(0, "", "")] + [(i + 1, r["before"], r["after"]) for i, r in enumerate(first)]
    around = F.broadcast(spark.createDataFrame(around, "n int, before string, after string"))  # 9 rows at most
    placed = _templates(spark).crossJoin(around)
    inside = F.when(F.col("n") % 3 == 1, F.concat_ws(" ", "before", "template")).when(F.col("n") % 3 == 2, F.concat_ws(" ", "template", "after")).otherwise(F.col("template"))
    placed = placed.select("family", tokens(inside).alias("words"), "unseen")
    other = spark.createDataFrame([(s, i % 3 == 2) for i, s in enumerate(OTHER_SENTENCES)], "line string, unseen boolean").crossJoin(around)
    other = other.select(F.lit(UNKNOWN).alias("family"), tokens(F.concat_ws(" ", "before", "line", "after")).alias("words"), "unseen")
    known = F.broadcast(templates.agg(F.collect_list("bigrams").alias("known")))  # one row
    lines = cued.distinct().withColumn("key", F.xxhash64("line")).orderBy("key", "line").limit(SAMPLE_LINES).withColumn("words", tokens(F.col("line"))).crossJoin(known)
    like = F.coalesce(template_share(F.col("words"), F.col("known")), F.lit(0.0)) >= LIKE_TEMPLATE
    negative = lines.where(~like).select(F.lit(UNKNOWN).alias("family"), "words", (F.pmod("key", F.lit(4)) == 0).alias("unseen"))
    return placed.unionByName(other).unionByName(negative)


class Model:
    """The fitted classifier: vocabulary, weights, temperature, and templates."""

    def __init__(self, spark: SparkSession, plain: DataFrame, cued: DataFrame):
        names = [UNKNOWN, *sorted(TEMPLATES)]
        self.names = names
        self.templates = materialize(_templates_with_bigrams(spark))
        self.known = materialize(_indexed(self.templates))
        label = F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("double") - 1
        rows = training_rows(spark, plain, cued, self.templates)
        rows = materialize(rows.select(label.alias("label"), features(F.col("words")).alias("grams"), "unseen").coalesce(1))
        self.stages = self._fit(rows.where(~F.col("unseen")))
        # the temperature that makes rows likeliest whose templates, sentences and lines the fit has not seen
        grid = F.explode(F.array(*[F.lit(t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)]))
        held = self._raw(rows.where("unseen")).withColumn("temperature", grid)
        p = F.element_at(self._softmax(F.col("temperature")), (F.col("label") + 1).cast("int"))
        losses = held.groupBy("temperature").agg(F.avg(-F.log(p + 1e-12)).alias("loss"))
        best = losses.orderBy("loss", "temperature").first()
        self.temperature = best["temperature"] if best else 1.0
        self.stages = self._fit(rows)

    @staticmethod
    def _fit(rows: DataFrame) -> PipelineModel:
        vectors = CountVectorizer(inputCol="grams", outputCol="vector", binary=True, vocabSize=VOCABULARY).fit(rows)
        fit = LogisticRegression(featuresCol="vector", family="multinomial", regParam=1e-3, maxIter=60).fit(vectors.transform(rows))
        return PipelineModel([vectors, fit])

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.stages.transform(rows).withColumn("raw", vector_to_array("rawPrediction")).drop("vector", "rawPrediction", "probability", "prediction")

    @staticmethod
    def _softmax(temperature: Column) -> Column:
        def scaled(raw: Column) -> Column:
            return let(F.array_max(raw), lambda top: F.transform(raw, lambda x: F.exp((x - top) / temperature)))

        return let(scaled(F.col("raw")), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total)))

    def classify(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs (line, ...) -> with family, probability, template_match, confirmed."""
        rows = paragraphs.withColumn("words", tokens(F.col("line"))).withColumn("grams", features(F.col("words")))
        # written out: what follows names the scores often, and only cued paragraphs come here
        rows = materialize(self._raw(rows).withColumn("p", self._softmax(F.lit(self.temperature))).drop("raw", "grams"))
        families = F.slice("p", 2, len(self.names) - 1)
        best = F.array_max(families)
        name = F.element_at(F.array(*map(F.lit, self.names[1:])), F.array_position(families, best).cast("int"))
        # the unknown class also takes what no family reaches
        sure = (best >= MIN_PROBABILITY) & (best > F.element_at("p", 1))
        rows = rows.withColumn("probability", F.round(best, 4)).withColumn("family", F.when(sure, name).otherwise(F.lit(UNKNOWN))).drop("p")
        rows = rows.join(F.broadcast(self.known), F.col("family") != UNKNOWN, "left")  # one row, none for unknown
        found = best_template(F.col("words"), F.col("templates"), F.col("keys"))
        rows = rows.withColumn("best", F.when(F.col("family") != UNKNOWN, found)).drop("words", "templates", "keys")
        rows = rows.withColumn("template_match", F.round(F.coalesce(F.when(F.col("best.family") == F.col("family"), F.col("best.share")), F.lit(0.0)), 4))
        return rows.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("template_match") >= MIN_TEMPLATE)).drop("best")


def _units(text: Column) -> Column:
    """array of (run, size, line): the cued lines, in order, then the joins that may hold a notice.
    A run is what stands between blank lines; size is the number of lines."""
    runs = F.filter(F.split(text, rf"\n[{SPACE}]*\n"), lambda r: r.rlike(_GATE))

    def lines_of(run: Column) -> Column:
        return F.filter(F.split(run, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def unit(run: Column, size, line: Column) -> Column:
        return F.struct(run.alias("run"), (size if isinstance(size, Column) else F.lit(size)).alias("size"), line.alias("line"))

    def single(run: Column, k: Column) -> Column:
        return F.transform(F.filter(lines_of(run), lambda x: x.rlike(_GATE)), lambda x: unit(k, 1, x))

    def joins(run: Column, k: Column) -> Column:
        def of(lines: Column) -> Column:
            n = F.size(lines)
            none = F.array().cast("array<struct<run:int,size:int,line:string>>")

            def windows(size: int) -> Column:
                at = F.sequence(F.lit(1), n - (size - 1))
                return F.when(n >= size, F.transform(at, lambda i: unit(k, size, F.array_join(F.slice(lines, i, size), " ")))).otherwise(none)

            whole = F.when(n > JOINED_LINES, F.array(unit(k, n, F.array_join(lines, " ")))).otherwise(none)
            return F.filter(F.concat(*map(windows, range(2, JOINED_LINES + 1)), whole), lambda u: u["line"].rlike(_NOTICE))

        return let(lines_of(run), of)

    return let(runs, lambda rs: F.concat(F.flatten(F.transform(rs, single)), F.flatten(F.transform(rs, joins))))


def _lines_and_wrapped(units: DataFrame) -> DataFrame:
    """The lines, and of each run and family that no line of it confirms, the shortest confirmed join, in
    place of that family's lines there."""
    by = ("row", "run", "family")
    is_line = F.col("size") == 1
    stated = F.max(F.when(is_line, F.col("confirmed")).otherwise(F.lit(False))).over(Window.partitionBy(*by))
    place = F.when(~is_line & F.col("confirmed"), F.struct("size", "para"))
    best = F.min(place).over(Window.partitionBy(*by))
    rows = units.withColumn("stated", stated).withColumn("best", F.when(~F.col("stated"), best))
    keep = F.when(F.col("best").isNull(), is_line).otherwise(F.struct("size", "para") == F.col("best"))
    return rows.where(keep).drop("stated", "best", "run", "size")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables. Per input row: row, id, n_paragraphs, n_cued. Per cued paragraph: row, para
    (its number among the row's paragraphs with a cue, from 1), line, family, probability,
    template_match, confirmed. A family that only joined lines confirm has one row for a run, the
    joined lines, whose para follows those of the lines; it stands for that family's lines there.

    Null and empty texts have no paragraphs. Repeated rows are scanned each for itself; an empty
    table gives empty results (the model is then fitted on its fixed sentences alone); other
    columns are ignored. Only the
    classified units of one run of lines come together in a shuffle.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    gated = F.when(F.col("text").rlike(_GATE), _units(F.col("text"))).otherwise(F.array().cast("array<struct<run:int,size:int,line:string>>"))
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lines.alias("lines"))
    # one line of each text, by position of its hash, is what templates are placed in
    one = F.get("lines", F.pmod(F.xxhash64("text"), F.size("lines")).cast("int"))
    marked = marked.select(F.monotonically_increasing_id().alias("row"), "id", F.size("lines").cast("long").alias("n_paragraphs"), gated.alias("cued"), F.when(F.size("lines") > 0, one).alias("sample_line"))
    marked = materialize(marked)
    plain = marked.select(F.col("sample_line").alias("line")).where(~F.col("line").rlike(_GATE))
    cued = marked.select(F.explode(F.filter("cued", lambda u: u["size"] == 1)).alias("unit")).select("unit.line")
    model = Model(docs.sparkSession, plain, cued)
    paragraphs = marked.where(F.size("cued") > 0).select("row", F.posexplode("cued").alias("para", "unit")).select("row", (F.col("para") + 1).alias("para"), "unit.*")
    n_cued = F.size(F.filter("cued", lambda u: u["size"] == 1)).cast("long")
    return marked.select("row", "id", "n_paragraphs", n_cued.alias("n_cued")), _lines_and_wrapped(model.classify(paragraphs))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its families (sorted, joined by commas), how many paragraphs state one, how
    many predictions no template confirmed, and the least probability among the confirmed."""
    rows, paragraphs = scan(read(spark, sf_dir, "documents"))
    named = paragraphs.where(F.col("family") != UNKNOWN).groupBy("row").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count(F.when(F.col("confirmed"), 1)).alias("n_licensed"),
        F.count(F.when(~F.col("confirmed"), 1)).alias("n_unconfirmed"),
        F.min(F.when(F.col("confirmed"), F.col("probability"))).alias("min_probability"),
    )
    out = rows.join(named, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_paragraphs", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_licensed", zero).alias("n_licensed"), F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"), "min_probability")
