"""Every assertion on a fragment that breaks it, and fragments that break none."""

import pytest

from pagelens.operators import assertions
from pagelens.plans.examples import BREAKS as BAD
from pagelens.plans.examples import whole_page as page
from pagelens.sources.html_nodes import html_nodes

GOOD = [
    "<h1>a</h1><h2>b</h2><h3>c</h3><article><h2>x</h2></article>",
    "<label for=q>x</label><input id=q required type=email maxlength=3><label>y<input></label>",
    "<table><colgroup><col><col></colgroup><thead><tr><th id=a scope=col>x<th>y</thead><tbody><tr><td headers=a>1<td>2</tbody></table>",
    "<table><tr><td colspan=2>x<tr><td>a<td><table><tr><td>n<td>m<td>o</table></table>",
    "<picture><source srcset='a 2x' media=print><img alt=x srcset='b 2x'></picture><img alt='' src=y><figure><img src=x><figcaption>z</figcaption></figure>",
    "<b role=tab aria-selected=true aria-controls=q>x</b><i role=tabpanel id=q>x</i><b role=tab aria-selected=true id=r>x</b><ul role='x tabpanel' aria-labelledby=r><li>x</ul>",
    "<div role=listbox aria-owns='k l'></div><b role=option id=l>x</b><div role=row aria-owns=c></div>".replace("<div role=row aria-owns=c></div>", "<div role=grid><div role=row><b role=cell>x</b></div></div>"),
    "<select required><option value=''>choose</option><option>x</option></select><select><button>x</button><option>y</select>",
    "<dl><dt>a<dd>b</dl><dl><dt>a<dd>c</dl><input autofocus><dialog><input autofocus></dialog><details><summary>x</summary></details>",
    "<meter min=1 max=3 value=2 low=1 high=3 optimum=2>x</meter><progress value=.5>x</progress><a href=x><img alt=x ismap></a>",
    "<script></script><script src=x integrity=y></script><script type=module></script><script type=importmap>{}</script><link rel=stylesheet href=x integrity=y disabled>",
    "<article><header role=banner>x</header><h2>y</h2></article><ruby>a<rt>b</ruby><p itemscope itemtype=x itemid=y><b itemprop=n>z</b></p>",
    "<svg><title>x</title><a><text>y</text></a></svg><header>x</header><footer>y</footer><form id=f accept-charset=UTF-8></form><input form=f>",
]


@pytest.fixture(scope="module")
def found(spark):
    pages = [(k, page(x)) for k, x in enumerate(BAD.values())] + [(1000 + k, page(x)) for k, x in enumerate(GOOD)] + [(2000, None), (2001, ""), (2002, "plain")]
    nodes = html_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    out = {}
    for r in assertions.assertion_findings(nodes).collect():
        out.setdefault(r.page_id, []).append((r.rule_id.removeprefix("assertion."), r.severity, r.pre))
    return out


def test_there_are_282(spark):
    ids = assertions.rule_ids()
    assert len(ids) == len(set(ids)) == 282 and {i.removeprefix("assertion.") for i in ids} == set(BAD)


def test_each_is_found(found):
    assert [name for k, name in enumerate(BAD) if name not in {x[0] for x in found.get(k, [])}] == []


def test_nothing_else_is_found(found):
    assert {k - 1000: v for k, v in found.items() if k >= 1000} == {}


def test_first_rule_of_a_pattern_judges(found):
    names = list(BAD)
    assert [x[0] for x in found[names.index("elements.a-href-in-a")] if x[0].endswith("-in-a")] == ["elements.a-href-in-a"]
