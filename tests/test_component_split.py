"""No link at the threshold, and no near copy, crosses the split."""

from itertools import combinations

from tessella.plans.catalog import QUERIES
from tests.test_near_dup import components

SF = "/root/testdata/sf0.001"


def test_components_follow_all_links(spark):
    entries = {r.doc_id: (r.kind, set(r.terms.split(" "))) for r in QUERIES["entry_view"](spark, SF).collect()}
    links = {(a, b) for a, b in combinations(sorted(entries), 2) if entries[a][0] == entries[b][0] and len(entries[a][1] & entries[b][1]) / len(entries[a][1] | entries[b][1]) >= 0.08}
    links |= {(r.component, r.doc_id) for r in QUERIES["near_dup_components"](spark, SF).where("doc_id <> component").collect()}
    nodes = {x for link in links for x in link}
    got = QUERIES["component_split"](spark, SF).collect()
    assert {r.node: r.component for r in got} == components(nodes, links)
    assert len({(r.component, r.split) for r in got}) == len({r.component for r in got})
