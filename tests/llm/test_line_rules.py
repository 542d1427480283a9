from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from spendguard.llm import line_rules

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_chars"]


def _lines(text):
    plain = re.sub(r"[0-9]+", "0", re.sub(r"[\t\v\f\r ]", "", text.lower()))
    return [x for x in plain.split("\n") if x]


def brute(rows, max_documents, max_share, max_removed):
    """(id, text, host) rows by definition; a row without an id is a document of its own."""
    who = [(False, i, 0) if i is not None else (True, 0, k) for k, (i, _, _) in enumerate(rows)]
    holders, hosts = defaultdict(set), defaultdict(set)
    for w, (_, text, host) in zip(who, rows):
        hosts[host].add(w)
        for line in _lines(text or ""):
            holders[host, line].add(w)
    gone = {k: min(v) for k, v in holders.items() if len(v) > max_documents and len(v) > max_share * len(hosts[k[0]])}
    out = []
    for w, (i, text, host) in zip(who, rows):
        text = text or ""
        words = re.findall(r"[^ \t\n\v\f\r]+", text)
        windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        repeat = len({k + d for k, x in enumerate(windows) if often[x] > 1 for d in range(3)})
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^ \t\n\v\f\r]", line):
                dup += line in seen
                seen.add(line)
        removed = [x for x in _lines(text) if (host, x) in gone and gone[host, x] != w]
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        chars = sum(map(len, words))
        out.append((i, len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed,
                    not failed and sum(map(len, removed)) <= max_removed * chars, len(removed), sum(map(len, removed))))
    return out


def _found(df):
    return [tuple(r) for r in df.select("doc_id", *COLUMNS).collect()]


def _sorted(rows):
    return sorted(rows, key=repr)


def _texts():
    unique = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(60))
    shared = "Accept   all cookies 2024 now"
    rows = [(k, f"{shared}\n{unique} id{chr(97 + k)}", "a") for k in range(7)]                      # one line of each is shared
    rows += [(10 + k, "\n".join([f"{x} shared line" for x in unique.split()]), "b") for k in range(8)]  # all lines are shared
    rows += [(20, "accept ALL\tcookies 7 now\n" + unique, "a"), (21, shared + "\n" + unique, None), (22, shared, "c")]
    rows += [(23, "a b c " * 40, "c"), (24, "a " * 60, "c"), (25, " ".join(f"q{k}" for k in range(49)), "c")]
    rows += [(26, "x # y\n\n x # y\nx # y\r\n", "c"), (27, None, "c"), (28, "", "c"), (29, " \n\t\v ", "c")]
    rows += [(30, "ß Ünï cödé <b>&amp;</b> $5 | *\n" * 2 + unique, "c")]
    return rows


@pytest.mark.parametrize("limits", [(5, 0.01, 0.5), (2, 0.5, 0.9), (0, 0.0, 0.1), (100, 0.0, 0.5)])
def test_rows_as_by_definition(spark, limits):
    rows = _texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.line_rules(docs, max_documents=limits[0], max_share=limits[1], max_removed=limits[2])
    assert _sorted(_found(got)) == _sorted(brute(rows, *limits))


def test_depleted_documents_go_and_the_first_one_stays(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in line_rules.line_rules(docs).collect()}
    assert [kept[10 + k] for k in range(8)] == [True] + [False] * 7
    assert all(kept[k] for k in range(7))  # losing a short line depletes nobody


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    line = " ".join(f"word{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(10))
    rows = [(1, line, "h")] * 9 + [(2, line, "h"), (None, line, "h"), (None, line, "h"), (None, line, None)]
    docs = spark.createDataFrame([(*r, 5, "z", "u") for r in rows], "doc_id long, text string, source string, key int, _row string, n_words string")
    for few in (line_rules.BROADCAST_LINES, 0):
        got = line_rules.line_rules(docs, max_documents=3, broadcast_lines=few)
        assert _sorted(_found(got)) == _sorted(brute(rows, 3, 0.01, 0.5))
        assert Counter((r.doc_id, r.kept) for r in got.collect()) == {(1, True): 9, (2, False): 1, (None, False): 2, (None, True): 1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_rules.line_rules(docs).collect() == []


def test_very_long_text_that_repeats_itself(spark):
    words = [f"t{k % 40_000}" for k in range(100_000)] + ["end"]
    rows = [(1, " ".join(words), "h"), (2, "same\n" * 200_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert _sorted(_found(line_rules.line_rules(docs))) == _sorted(brute(rows, 5, 0.01, 0.5))


def test_only_native_operations(spark):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string, source string")
    plan = line_rules.line_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
