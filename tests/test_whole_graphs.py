"""Graph queries whose graphs grow with the tables, against brute force on more rows than a fixed size would reach."""

import re

from scriptorium.plans import registry


def test_page_components(spark, tmp_path):
    html = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    rows = [(i, html(f"/{i // 3}", f"/{i // 3 + 1}" if i % 3 == 2 and i % 4 else f"/own{i}")) for i in range(300)]
    rows += [(300, ""), (301, None), (None, html("/0"))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    cited = {i: set(re.findall('<a href="([^"]*)"', h or "")) for i, h in rows if i is not None}
    label = dict.fromkeys(cited)
    for i in cited:
        todo = [i] if label[i] is None else []
        while todo:
            j = todo.pop()
            if label[j] is None:
                label[j] = i
                todo += [k for k in cited if cited[j] & cited[k]]
    got = registry.queries()["page_components"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["label"]) for r in got) == sorted(label.items())
    assert len(set(label.values())) > 10


def test_references_and_links_reach_every_document(spark, tmp_path):
    n = 3000
    docs = [(i, "x", "en", f"s{i % 3}", 2) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    todo, kept = list(range(0, n, 97)), set()
    while todo:
        i = todo.pop()
        if i not in kept:
            kept.add(i)
            todo += [(3 * i + 1) % n] if i % 2 == 0 else []
    assert any(i >= 1300 and i % 97 for i in kept)
    want = {}
    for i in set(range(n)) - kept:
        if i % 50 != 9:
            want[f"s{i % 3}"] = want.get(f"s{i % 3}", 0) + 1
    got = registry.queries()["whole_reachable_gc"](spark, str(tmp_path)).collect()
    assert {r["source"]: (r["unused"], r["chars"]) for r in got} == {s: (c, 2 * c) for s, c in want.items()}
    edges = {(f"en/d{i}", f"en/d{t}") for i in range(n) if i % 5 and i % 7 for t in ((7 * i + 3) % n, (3 * i + 1) % n) if t != i}
    assert {tuple(r) for r in registry.queries()["whole_graph_edges"](spark, str(tmp_path)).collect()} == edges
    assert max(int(t.split("/d")[1]) for _, t in edges) >= 1300
