from collections import defaultdict

from tests.conftest import SMALL

from lodestone.llm import common, line_dedup
from lodestone.llm.queries import QUERIES


def by_hand(rows, least_sites=line_dedup.LEAST_SITES):
    """(id, text, source) rows to (id, text after, lines dropped)."""
    sites, texts = defaultdict(set), defaultdict(set)
    cut = lambda t: [x.strip(" ") for x in (t or "").split("\n")]
    for _, text, source in rows:
        for line in cut(text):
            if len(line) >= line_dedup.LEAST_CHARS:
                texts[line].add(text)
                sites[line] |= {source} - {None}
    out = []
    for i, text, _ in rows:
        drop = [k for k, line in enumerate(cut(text)) if min(len(sites[line]), len(texts[line])) >= least_sites]
        rest = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
        out.append((i, rest, len(drop)))
    return sorted(out, key=repr)


def result(df, **more):
    return sorted(((r.doc_id, r.text, r.n_dropped) for r in line_dedup.remove_boilerplate(df, **more).collect()), key=repr)


def test_thresholds_by_hand(documents):
    rows = []
    for n, line in enumerate(["on five sites only", "on six sites, enough", "on thirty sites, far above", "tiny", "many times on one site"]):
        for site in range([5, 6, 30, 30, 1][n]):
            rows.append((len(rows), f"own words of document {len(rows)} which is long enough to stay whole\n  {line} \nand its end {len(rows)}", f"s{site}"))
    rows += [(900 + k, "many times on one site\nsomething else that is longer than that " + str(k), "s1") for k in range(40)]
    rows += [(990, "on six sites, enough", "s9"), (991, "on six sites, enough\nmore of it but not from any site at all, null", None)]
    assert result(documents(*rows)) == by_hand(rows)


def test_copies_and_mostly_boilerplate(documents, monkeypatch):
    """A text copied to many sites stays; a passage of many texts goes, however much of a document it is."""
    rows = [(k, "a text that was copied to many sites\nwith all of its lines", f"s{k}") for k in range(30)]
    passage = "a passage that very many documents have " * 8
    rows += [(100 + k, f"{passage}\nown line of document {k}", f"s{k}") for k in range(30)]
    got = result(documents(*rows))
    assert got == by_hand(rows)
    assert {n for _, _, n in got} == {0, 1} and all(t == f"own line of document {i - 100}" for i, t, n in got if n)
    monkeypatch.setattr(line_dedup, "MOST_BYTES", 10)
    monkeypatch.setattr(common, "MOST_BROADCAST", 1)
    assert result(documents(*rows)) == got


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    for least in (1, 2, 3):
        assert result(odd, least_sites=least) == by_hand(rows, least)
    out = line_dedup.remove_boilerplate(odd)
    assert out.columns == [*odd.columns, "n_dropped"]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert line_dedup.remove_boilerplate(odd.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op8_line_dedup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
