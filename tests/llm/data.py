"""Small document tables with the awkward cases: nulls, empty and long texts, copies, repeated rows."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward_rows() -> list[tuple]:
    base = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base, "en", "a", 100),
        (2, base.lower(), "en", "a", 100),
        (3, base + " phi", None, "a", 100),
        (4, None, "en", None, None),
        (5, "", "en", "b", 0),
        (6, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (7, "one", "en", "b", 3),
        (8, "one", "en", "b", 3),
        (9, "Mail me at jo.doe+x@mail.example.com or +49 (30) 1234-5678 from 10.0.0.255, card 4111 1111 1111 1111.", "en", "c", 90),
        (10, "not 999.1.2.3 and not 4111 1111 1111 1112 but 4012888888881881; a@b@c.de; x@y", "en", "c", 90),
        (11, "IBAN: GB82 WEST 1234 5698 7654 32 and iban GB82WEST12345698765433, my SSN 123-45-6789", "en", "c", 90),
        (12, "word " * 4000 + "\n" + "1 2-3 " * 3000 + "@" * 500 + "9" * 5000, "de", "c", 50000),
        (13, "Licensed under the Apache License, Version 2.0.\nThis is CC-BY and the GNU General Public License. All rights reserved", "en", "d", 100),
        (14, "cc by cc by ccby All Rights-Reserved", "en", "d", 100),
        (15, "Émile 😀 wrote été at émile@exämple.com — 8.8.8.8", "fr", "d", 100),
        (15, "Émile 😀 wrote été at émile@exämple.com — 8.8.8.8", "fr", "d", 100),
        (None, "a row without an id", "en", "a", 19),
        (17, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation files", "en", None, 1),
    ]
    return rows


def awkward(spark):
    """With extra columns whose names clash with those that operators use inside."""
    rows = [(*r, 7, "x", 1, 2, 3, 4, 5, "y") for r in awkward_rows()]
    return spark.createDataFrame(rows, SCHEMA + ", size int, kind string, node int, id int, bucket int, n int, shard int, __key string")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
