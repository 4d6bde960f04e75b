"""License scans with a positional index of rare licence words.

Licence templates, notices and whole licences, are indexed by their words of
highest inverse document frequency: a word's postings are (template, position).
Each file looks up all indexed words that it holds. A template of which enough
words are there is a candidate; each match at word p of the file and q of a
candidate then votes for (template, p - q), so words that stand in the template's
order agree on one offset. A candidate counts when enough of its rare words agree
and its mandatory phrase is there. Column expressions do all of it, and nothing is
shuffled but the document counts of the templates' words.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, mandatory phrase, wording of the licence or its notice.
TEMPLATES = [
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl", "gnu general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    (
        "mit", "permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished "
        "to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is "
        "provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event "
        "shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
    ),
    (
        "isc", "permission to use copy modify and or distribute this software",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
        "in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
        "shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
        "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "bsd-3-clause", "to endorse or promote products derived from this software",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
        "distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission",
    ),
    (
        "zlib", "this software is provided as is without any express or implied warranty",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted "
        "to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software "
        "must not be misrepresented you must not claim that you wrote the original software",
    ),
    (
        "unlicense", "free and unencumbered software",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a "
        "compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "bsl-1.0", "boost software license version 1 0",
        "boost software license version 1 0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        "license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    ),
]

#: Fixed pattern: what parts words.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RARE_WORDS, AGREEING = 8, 0.6


def lowered(text: Column) -> Column:
    """text with A-Z in lower case, as far as licence words can tell: letters beyond ASCII may change among themselves only.

    The two whose lower case holds an ASCII letter are hidden first.
    """
    odd = text.contains("\u0130") | text.contains("\u212a")
    return F.lower(F.when(odd, F.translate(text, "\u0130\u212a", "\u00d7\u00d7")).otherwise(text))


def _words(docs: DataFrame) -> DataFrame:
    """docs with _t, the lower-cased text, _w, what stands between what parts words, and _lead, 1 if the first is blank."""
    split = docs.withColumn("_t", lowered(F.coalesce("text", F.lit("")))).withColumn("_w", F.split("_t", APART))
    blank = lambda c: F.when(c == "", 1).otherwise(0)
    lead, end = blank(F.col("_w")[0]), blank(F.element_at("_w", -1))
    count = F.when(F.size("_w") == 1, 1 - lead).otherwise(F.size("_w") - lead - end)
    return split.withColumn("_lead", lead).withColumn("n_words", count.cast("long"))


def vocabulary() -> list[str]:
    return sorted({w for _, _, wording in TEMPLATES for w in wording.split()})


def inverse_document_frequencies(docs: DataFrame) -> dict[str, float]:
    """ln((rows + 1) / (rows with the word + 1)) over all docs, of the templates' words alone."""
    own = F.array(*map(F.lit, vocabulary()))
    found = _words(docs).select(F.explode(F.array_intersect("_w", own)).alias("w")).groupBy("w").count().collect()  # one row per template word
    rows = docs.count()
    df = {r["w"]: r["count"] for r in found}
    return {w: math.log((rows + 1) / (df.get(w, 0) + 1)) for w in vocabulary()}


def _rarest(idf: dict[str, float]) -> list[list[tuple[str, int]]]:
    """Of each template, its rarest words with their positions."""
    out = []
    for _, _, wording in TEMPLATES:
        placed = list(enumerate(wording.split()))
        placed.sort(key=lambda x: (-idf[x[1]], x[0]))
        out.append([(w, q) for q, w in placed[:RARE_WORDS]])
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Base
    labels come from every place where a phrase of PHRASES stands; the index adds
    labels of its own. score is the best share of a template's rare words that
    agree, at least 0.5 with a base label. Null and empty texts give no labels,
    null places and score 0. Repeated rows are scanned alike; an empty table
    gives no rows. Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    idf = inverse_document_frequencies(docs)
    rare = _rarest(idf)
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    # the file's licence words, all that are in the index, looked up there
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, words in enumerate(rare):
        for w, q in words:
            postings.setdefault(w, []).append((t, q))
    order = sorted(postings)
    rows = _words(docs).withColumn("_own", F.array_intersect(F.array(*map(F.lit, order)), "_w"))
    # a template is a candidate if the file holds enough different words of it
    of = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*[F.lit(w) for w in sorted({w for w, _ in words})]).alias("words"), F.lit(len(words) - math.ceil(AGREEING * len(words))).alias("spare")) for t, words in enumerate(rare)])
    candidates = F.transform(F.filter(of, lambda k: F.size(F.array_except(k["words"], F.col("_own"))) <= k["spare"]), lambda k: k["t"])
    fewest = min(len({w for w, _ in words}) - (len(words) - math.ceil(AGREEING * len(words))) for words in rare)
    rows = rows.withColumn("_candidates", F.when(F.size("_own") >= fewest, candidates).otherwise(empty("int")))
    triggers = sorted(PHRASES)
    longest = sorted({max(t.split(), key=len) for t in triggers})
    maybe = reduce(lambda a, b: a | b, [F.col("_t").contains(w) for w in longest])  # base phrases need one of these words
    rows = rows.withColumn("_plain", F.when(maybe | (F.size("_candidates") > 0), F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))))
    base_there = F.coalesce(F.exists(F.array(*[F.lit(f" {t} ") for t in triggers]), lambda t: F.contains(F.col("_plain"), t)), F.lit(False))
    rows = rows.withColumn("_based", base_there)

    # base phrases, at every word
    at = lambda i: F.get(F.col("_w"), i)
    stands = lambda phrase: lambda i: reduce(lambda a, b: a & b, [at(i + k) == w for k, w in enumerate(phrase.split())])
    where = F.sequence(F.lit(0), F.size("_w") - 1)
    none = empty("int")
    rows = rows.withColumns({f"_p{k}": F.when(F.col("_based"), F.filter(where, stands(p))).otherwise(none) for k, p in enumerate(PHRASES)})
    sizes = {label: F.size(f"_p{k}") for k, label in enumerate(PHRASES.values())}
    rows = rows.withColumn("_all", F.concat(*[f"_p{k}" for k in range(len(PHRASES))]))

    # candidates' postings meet the file's words by relative position
    index = F.create_map(*[x for w in order for x in (F.lit(w), F.array(*[F.lit(t << 40 | (1 << 32) - q) for t, q in postings[w]]))])
    # named twice, for a column named once would be worked out anew for every word
    hits = F.filter(where, lambda i: (F.size("_own") > 0) & F.array_contains("_own", at(i)))
    votes = F.flatten(F.transform(hits, lambda i: F.transform(F.element_at(index, at(i)), lambda code: code + i)))
    votes = F.array_sort(F.filter(votes, lambda v: F.array_contains("_candidates", F.shiftright(v, 40).cast("int"))))
    rows = rows.withColumn("_votes", F.when(F.size("_candidates") > 0, votes).otherwise(empty("bigint")))
    # runs of equal votes: how many words of a template agree on an offset
    n = F.size("_votes")
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get("_votes", i) != F.get("_votes", i + 1)))
    rows = rows.withColumn("_ends", F.when(n > 0, ends).otherwise(none))
    runs = F.transform("_ends", lambda i, k: F.struct((F.shiftright(F.get("_votes", i), 40)).cast("int").alias("t"), (i - F.coalesce(F.when(k > 0, F.get("_ends", k - 1)), F.lit(-1))).alias("n")))
    rows = rows.withColumn("_runs", runs)
    known = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(f" {phrase} ").alias("phrase"), F.lit(len(rare[t])).alias("n")) for t, (label, phrase, _) in enumerate(TEMPLATES)])
    best = lambda k: F.aggregate("_runs", F.lit(0), lambda m, r: F.greatest(m, F.when(r["t"] == k["t"], r["n"]).otherwise(0)))
    shares = F.transform(known, lambda k: F.struct(k["label"].alias("label"), F.least(F.lit(1.0), best(k) / k["n"]).alias("share"), F.contains(F.col("_plain"), k["phrase"]).alias("sure")))
    rows = rows.withColumn("_sure", F.when(F.size("_candidates") > 0, F.filter(shares, lambda k: k["sure"] & (k["share"] >= AGREEING))))
    agreed = F.transform("_sure", lambda k: k["label"])
    base = [F.when(sizes[label] > 0, F.lit(label)) for label in PHRASES.values()]
    base = F.array_compact(F.array(*base))
    joined = lambda found: F.array_join(F.array_sort(F.array_distinct(found)), ",")
    place = lambda f: F.when(F.size("_all") > 0, f("_all") - F.col("_lead")).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_all").cast("long").alias("n_base"),
        place(F.array_min).alias("first_word"),
        place(F.array_max).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce(agreed, F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("_sure", lambda k: k["share"])), F.lit(0.0)), F.when(F.size("_all") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
