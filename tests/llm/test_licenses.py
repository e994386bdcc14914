import re

from heirloom.llm import licenses


def scanned(spark, *texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, licenses STRING, found INT")
    return [tuple(r)[1:] for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_every_known_sentence_has_a_mark():
    assert all(re.search(licenses.MARKS, said) for said in licenses.SENTENCES.values())
    known = set(licenses.SENTENCES)
    assert {p for _, parts in licenses.RULES for p in parts} <= known


def test_single_lines_and_wrapped_texts(spark):
    bsd = """1. Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
    name = """
3. Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission.
"""
    got = scanned(
        spark,
        "some prose without a stop\nLicensed under CC BY-NC 4.0.\nmore prose",
        bsd,
        bsd + name,
        "Released under the MIT License.\nx.\nReleased under the MIT License. Licensed under the Apache License, Version 2.0!",
        "This program is free software. Nothing else.",
    )
    assert got[0] == ("cc_by_nc_4", "CC-BY-NC-4.0", "")
    assert got[1][1:] == ("BSD-2-Clause", "") and got[2][1:] == ("BSD-3-Clause", "")
    assert got[3][1:] == ("Apache-2.0,MIT", "")
    assert got[4] == ("gpl_program", "", "gpl_program")


def test_nulls_empty_texts_and_tables(spark):
    assert scanned(spark, None, "", "no notice", "licence") == [("", "", "")] * 4
    assert scanned(spark) == []


def test_wrapped_texts_and_lines_in_one_document(spark):
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
    line = "some prose without a stop\nLicensed under CC BY-NC 4.0.\n"
    got = scanned(spark, bsd + line, line + bsd, bsd + line * 3, "Licensed under the Apache License, Version 2.0\n(the License).")
    assert [r[1:] for r in got[:3]] == [("BSD-2-Clause,CC-BY-NC-4.0", "")] * 3
    assert got[0][0] == "bsd_use,bsd_source,bsd_binary,cc_by_nc_4"
    assert got[1][0] == "cc_by_nc_4,bsd_use,bsd_source,bsd_binary"
    assert got[3] == ("apache2_the", "Apache-2.0", "")


def test_the_oracle_agrees_where_both_cuts_find_something(spark):
    import duckdb

    from heirloom.llm.sql import ORACLES

    wrapped = (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
        "following\nconditions are met:\n\nRedistributions of source code must retain the above copyright\nnotice, this list of "
        "conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice,\n"
        "this list of conditions and the following disclaimer in the documentation\nand/or other materials provided with the "
        "distribution.\n\n"
    )
    line = "some prose without a stop\nLicensed under CC BY-NC 4.0.\n"
    texts = [wrapped + line, line + "\n" + wrapped, line * 3 + wrapped, wrapped + line * 3, wrapped, line, "", None]
    rows = list(enumerate(texts)) + [(1, texts[1])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.execute(ORACLES["op6_license_scan"]).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    found = {r.doc_id: r.licenses for r in got}
    assert found[0] == found[1] == "BSD-2-Clause,CC-BY-NC-4.0"
