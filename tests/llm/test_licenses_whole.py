"""Licenses: notices that wrap, and long lines that merely hold all the words; whole results against SQL."""

import random

from oracle import sql_rows
from pyspark.sql import functions as F

from quillnet.llm.licenses import TEMPLATES, scan_licenses
from quillnet.llm.sql import OP4

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"


def test_wrapped_notices_and_long_lines(spark, docs):
    far = " filler words ".join(["x"] * 30).join("this work has been released into the public domain".split())
    d = docs(f"a line\n\n{MIT}", BSD, far, "This work has been released\ninto the public domain", "x " * 5000 + BSD.replace("\n", " "), f"{MIT}\n{BSD}\n{MIT}")
    r = {x["doc_id"]: x for x in scan_licenses(d).collect()}
    assert [r[k]["labels"] for k in range(6)] == ["mit", "bsd", "", "public-domain", "bsd", "bsd,mit"]
    assert [b["line"] for b in r[0]["blocks"]] == [2] and [b["line"] for b in r[5]["blocks"]] == [0, 2, 4]
    assert r[0]["score"] == 1.0 and r[2]["score"] == 0.0


def test_a_longer_notice_hides_no_other_place(spark, docs):
    both = "Licensed under CC BY 4.0" + " filler" * 50 + "\nLicensed under CC BY-SA 4.0"
    r = scan_licenses(docs(both)).first()
    assert [(b["line"], b["label"]) for b in r["blocks"]] == [(0, "cc-by-4.0"), (1, "cc-by-sa-4.0")]


def test_wrapped_and_damaged_notices_equal_sql(spark, docs, tmp_path):
    rng = random.Random(9)
    texts = ["", None, "!!!"]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            notice = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(notice))
                notice[k : k + rng.randrange(2)] = rng.choice([[], ["word"], [notice[k]], ["the", "of"]])
            words += notice + ["filler"] * rng.randrange(4)
        texts.append("".join(w + rng.choice([" ", "\n", ", "]) for w in words))
    d = docs(*texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = scan_licenses(d, carry=["doc_id"]).drop("blocks")
    assert sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(got.columns)))) for r in got.collect()) == sql_rows(OP4, str(tmp_path), got.columns)


def test_clashing_columns_and_no_rows(spark, docs):
    odd = docs("All rights reserved").select("*", *[F.lit("x").alias(c) for c in ("_text", "Labels", "score", "word", "n")])
    row = scan_licenses(odd).first()
    assert row["labels"] == "all-rights-reserved,reserved" and row["word"] == "x" and row["_text"] == "x"
    assert scan_licenses(odd.limit(0)).count() == 0
