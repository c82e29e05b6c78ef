from ledgerlark.llm import line_templates

SCHEMA = "doc_id long, text string, _at int, n_lines string, doc string, _drop string, _row string"


def run(spark, rows):
    df = line_templates.dedup_lines(spark.createDataFrame([(*r, 7, "n", "d", "x", "y") for r in rows], SCHEMA))
    assert df.columns == ["doc_id", "text", "_at", "doc", "_drop", "_row", "n_lines", "n_dropped"]
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


def prose(i):
    name = "".join(chr(97 + int(d)) for d in str(i * 7919 + 13))
    return "\n".join(f"{w} {name}{w} goes {w}{name} to {name}x{w} and {w}y{name} z{name}{w}" for w in ("alpha", "beta", "gamma", "delta"))


def test_recurring_lines_and_templates(spark):
    rows = [(i, f"All rights reserved.\n{prose(i)}\nPosted by user u{i} on page {i} of the forum") for i in range(8)]
    got = run(spark, rows)
    assert all(got[i] == (prose(i), 6, 2) for i in range(8))


def test_few_texts_keep_their_lines(spark):
    rows = [(i, f"Seldom seen line\n{prose(i)}") for i in range(4)]
    assert all(v[2] == 0 for v in run(spark, rows).values())


def test_exact_copies_count_once_and_shared_lines_go_whatever_their_share(spark):
    rows = [(i, prose(0)) for i in range(20)] + [(20 + i, prose(1) + f"\nlast {'x' * i}") for i in range(8)]
    got = run(spark, rows)
    assert all(got[i][2] == 0 for i in range(20)) and all(got[20 + i] == (f"last {'x' * i}", 5, 4) for i in range(8))


def test_many_dropped_lines(spark):
    rows = [(i, "\n".join(f"line {'abcdefghij'[j % 10]}{'klmnopqrst'[j // 10 % 10]}{'uvwxyzabcd'[j // 100 % 10]}{'efghijklmn'[j // 1000]}" for j in range(10000)) + f"\n{prose(i)}") for i in range(5)]
    assert all(got == (prose(i), 10004, 10000) for i, got in run(spark, rows).items())


def test_edge_cases(spark):
    rows = [(i, f"Common line here\n\n{prose(i)}") for i in range(6)] + [(10, None), (11, ""), (12, "\n\n"), (13, "Common line here"), (14, "x" * 300000), (5, f"Common line here\n\n{prose(5)}"), (None, f"Common line here\n{prose(77)}")]
    got = run(spark, rows)
    assert got[5] == ("\n" + prose(5), 6, 1) and got[None] == (prose(77), 5, 1)
    assert got[10] == (None, 0, 0) and got[11] == ("", 1, 0) and got[12] == ("\n\n", 3, 0) and got[13] == ("", 1, 1) and got[14][2] == 0


def test_empty(spark):
    assert run(spark, []) == {}


def grouped(spark, rows):
    return {r.doc_id: (r.text, r.n_dropped) for r in line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), by_groups=True).collect()}


def test_short_documents_lose_a_long_shared_notice(spark):
    notice = "This page is shown to you under the terms that all readers of this site have agreed to at some time before"
    rows = [(i, f"{notice}\nentry {prose(i)[:40]}") for i in range(8)] + [(50, notice)]
    got = grouped(spark, rows)
    assert all(got[i] == (rows[i][1].split("\n")[1], 1) for i in range(8)) and got[50] == ("", 1)


def test_near_copies_keep_their_lines_by_groups(spark):
    rows = [(i, prose(0)) for i in range(20)] + [(20 + i, prose(1) + f"\nlast {'x' * i}") for i in range(8)]
    assert all(n == 0 for _, n in grouped(spark, rows).values())


def test_long_lines_of_two_texts_stay_once(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    other = passage.replace("worda", "verba")
    rows = [(i, f"{passage}\n{prose(i)}") for i in (4, 2, 3)] + [(None, f"{prose(9)}\n{passage}")]
    rows += [(10, f"{other} x\n{prose(1)}\n{prose(5)}"), (11, f"{other} x\n{prose(1)}\n{prose(5)}"), (12, f"{other} x\n{prose(1)}\n{prose(5)} y")]
    got = grouped(spark, rows)
    assert got[2] == (rows[1][1], 0) and all(got[i] == (prose(i), 1) for i in (3, 4)) and got[None] == (prose(9), 1)
    assert all(got[i][1] == 0 for i in (10, 11, 12))
