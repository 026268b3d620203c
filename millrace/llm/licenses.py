"""License scans: sentences are normalised, known ones become identifiers, and ordered rules match sequences of identifiers.

Texts are cut into sentences twice: at line ends and sentence ends (notices that stand in a line of their own), and at sentence ends
and blank lines only (sentences wrapped over lines). A rule matches when its identifiers occur in this order in either sequence,
other sentences between them allowed. The first rule that matches names the license; all that match are listed.

Defined cases: null and empty texts have no sentence, no license (null) and an empty list; rows repeat as they come; an empty table gives an empty result;
further columns of the input are kept, those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

# Normalised sentences of license texts and notices as cut() leaves them ('software: you' and 'v. 2.0' end a sentence), with their identifiers.
SENTENCES = {
    "licensed under cc by nc 4 0": "CcByNc4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4",
    "licensed under cc by 4 0": "CcBy4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "this work is licensed under the gnu general public license version 3": "Gpl3Notice",
    "gnu general public license version 3 29 june 2007": "Gpl3Title",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "either version 3 of the license or at your option any later version": "Gpl3Either",
    "either version 2 of the license or at your option any later version": "Gpl2Either",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "licensed under the apache license version 2 0": "Apache2Short",
    "licensed under the apache license version 2 0 the license": "Apache2Notice",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheNoWarranty",
    "released under the mit license": "MitNotice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "MitGrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNoticeKept",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdNoEndorse",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "Mpl2Notice",
    "this source code form is subject to the terms of the mozilla public license v": "Mpl2Notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdDisclaimer",
    "apache license version 2 0 january 2004": "Apache2Title",
    "apache license version 2 0 january 2004 http www apache org licenses": "Apache2Title",
    "apache license version 2 0 january 2004 https www apache org licenses": "Apache2Title",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "Apache2Definition",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Plus",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Plus",
    "either version 2 1 of the license or at your option any later version": "Lgpl21Either",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v": "Epl2Notice",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "Cc0Dedication",
    "you should have received a copy of the cc0 public domain dedication along with this software": "Cc0Copy",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented": "ZlibOrigin",
    "boost software license version 1 0 august 17th 2003": "BoostTitle",
    "distributed under the boost software license version 1 0": "BoostNotice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
}
# Ordered rules, a license and the identifiers that must follow each other; more special ones come first.
RULES = [
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("MIT", ["MitGrant", "MitNoticeKept"]),
    ("Apache-2.0", ["Apache2Notice", "ApacheUse"]),
    ("Apache-2.0", ["Apache2Title"]),
    ("Apache-2.0", ["Apache2Definition"]),
    ("AGPL-3.0-or-later", ["Agpl3Plus"]),
    ("AGPL-3.0-or-later", ["AgplTerms", "Gpl3Either"]),
    ("LGPL-3.0-or-later", ["Lgpl3Plus"]),
    ("LGPL-3.0-or-later", ["LgplTerms", "Gpl3Either"]),
    ("LGPL-2.1-or-later", ["LgplTerms", "Lgpl21Either"]),
    ("GPL-3.0-or-later", ["Gpl3Plus"]),
    ("GPL-3.0-or-later", ["GplTerms", "Gpl3Either"]),
    ("GPL-2.0-or-later", ["Gpl2Plus"]),
    ("GPL-2.0-or-later", ["GplTerms", "Gpl2Either"]),
    ("GPL-3.0", ["Gpl3Notice"]),
    ("GPL-3.0", ["Gpl3Title"]),
    ("Apache-2.0", ["Apache2Short"]),
    ("MIT", ["MitNotice"]),
    ("MIT", ["MitGrant"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("MPL-2.0", ["Mpl2Notice"]),
    ("ISC", ["IscGrant"]),
    ("Unlicense", ["Unlicense"]),
    ("EPL-2.0", ["Epl2Notice"]),
    ("CC0-1.0", ["Cc0Dedication"]),
    ("CC0-1.0", ["Cc0Copy"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("Zlib", ["ZlibGrant", "ZlibOrigin"]),
    ("BSL-1.0", ["BoostTitle"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostNotice"]),
]
# Each known sentence holds one of these, so texts without any need no cutting.
HINTS = ("licens", "redistribut", "permission", "software", "endorse")
assert all(any(h in s for h in HINTS) for s in SENTENCES)

GAP = r"[\x20\x09-\x0D]"
MARKS = "-_/\\.,;:!?()[]{}<>\"'`*#|&$%@+=~^"


def normalised(sentence: Column) -> Column:
    """Lower case in A-Z, marks as spaces, one space between words, none around."""
    plain = F.translate(sentence, UPPER + MARKS, LOWER + " " * len(MARKS))
    return F.trim(F.regexp_replace(plain, f"{GAP}+", " "))


def identifiers(sentences: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    few = F.filter(sentences, lambda s: F.lower(s).rlike("|".join(HINTS)))
    return F.filter(F.transform(few, lambda s: F.element_at(known, normalised(s))), lambda x: x.isNotNull())


def cut(text: Column, wrapped: bool) -> Column:
    ended = F.regexp_replace(F.concat(text, F.lit("\n")), f"[.;!?:]+{GAP}", "\n\n")
    return F.split(ended, f"\n{GAP}*\n") if wrapped else F.split(ended, "\n")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds sentence_ids (identifiers in order, by line), license (of the first rule that matches, or null) and licenses (all, in rule order)."""
    d = docs.withColumn("z_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("z_any", F.lower("z_t").rlike("|".join(HINTS)))
    for name, wrapped in (("z_a", False), ("z_b", True)):
        d = d.withColumn(name, F.when(F.col("z_any"), identifiers(cut(F.col("z_t"), wrapped))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("z_sa", F.concat(F.lit(","), F.array_join("z_a", ","), F.lit(","))).withColumn("z_sb", F.concat(F.lit(","), F.array_join("z_b", ","), F.lit(",")))
    hits = []
    for name, ids in RULES:
        pattern = "," + ",(?:.*,)?".join(ids) + ","
        hits.append(F.when(F.col("z_sa").rlike(pattern) | F.col("z_sb").rlike(pattern), F.lit(name)))
    d = d.withColumn("z_hits", F.when(F.size("z_a") + F.size("z_b") > 0, F.array_distinct(F.array_compact(F.array(*hits)))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("sentence_ids", F.array_join("z_a", ",")).withColumn("license", F.get("z_hits", F.lit(0))).withColumn("licenses", F.array_join("z_hits", ","))
    return d.drop("z_t", "z_any", "z_a", "z_b", "z_sa", "z_sb", "z_hits")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "sentence_ids", "license", "licenses")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """The same rows in DuckDB: sentences as rows of a table, rules as patterns."""
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    plain = f"translate(s, {quoted(UPPER + MARKS)}, {quoted(LOWER + ' ' * len(MARKS))})"
    ended = f"regexp_replace(coalesce(text, '') || chr(10), '[.;!?:]+{GAP}', chr(10) || chr(10), 'g')"
    rules = ", ".join(f"({k}, {quoted(n)}, {quoted(',' + ',(?:.*,)?'.join(ids) + ',')})" for k, (n, ids) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(k, name, pattern) AS (VALUES {rules}),
cut AS (SELECT row_number() OVER () AS r, doc_id, string_split({ended}, chr(10)) AS a, string_split_regex({ended}, '\\n{GAP}*\\n') AS b FROM documents),
parts AS (SELECT r, 'a' AS kind, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM cut UNION ALL SELECT r, 'b', unnest(b), generate_subscripts(b, 1) FROM cut),
ids AS (SELECT r, kind, string_agg(id, ',' ORDER BY i) AS ids FROM parts JOIN known ON trim(regexp_replace({plain}, '{GAP}+', ' ', 'g')) = sentence GROUP BY r, kind),
both_kinds AS (SELECT r, coalesce(max(ids) FILTER (WHERE kind = 'a'), '') AS a, coalesce(max(ids) FILTER (WHERE kind = 'b'), '') AS b FROM ids GROUP BY r),
hits AS (SELECT r, name, min(k) AS k FROM both_kinds, rules WHERE regexp_matches(',' || a || ',', pattern) OR regexp_matches(',' || b || ',', pattern) GROUP BY r, name),
named AS (SELECT r, arg_min(name, k) AS license, string_agg(name, ',' ORDER BY k) AS licenses FROM hits GROUP BY r)
SELECT doc_id, coalesce(x.a, '') AS sentence_ids, n.license, coalesce(n.licenses, '') AS licenses
FROM cut LEFT JOIN both_kinds x USING (r) LEFT JOIN named n USING (r)"""
