"""Fragments of markup, one for each rule that it breaks: what the example queries put into pages, and what tests hold the rules against."""

from __future__ import annotations

from pagelens.operators import assertions

HIDING = "button details embed iframe label select textarea"
#: Assertion: markup that breaks it.
BREAKS = {
    "author-requirements.group-in-list": "<div role=list><div role=group></div></div>",
    "author-requirements.group-in-menu": "<div role=menu><div role=group><b role=button>x</b></div></div>",
    "author-requirements.group-in-tree": "<div role=tree><p role=group><b role=button>x</b></p></div>",
    "author-requirements.rowgroup-child-must-be-row": "<div role=rowgroup><b>x</b></div>",
    "presentation-role.img-empty-alt-with-aria": "<img alt='' role=none aria-hidden=true>",
    "img-role-needs-accessible-name.has-name": "<img role=none>",
    "img-aria-needs-accessible-name.has-name": "<img aria-relevant=all>",
    "presentational-children.label-descendant": "<div role=math><label>x</label></div>",
    "roles-properties-global.disabled-on-main": "<div role=main aria-disabled=true></div>",
    "roles-properties-global.haspopup-on-main": "<div role=main aria-haspopup=true></div>",
    "roles-properties-global.invalid-on-main": "<div role=main aria-invalid=true></div>",
    "aria-placeholder.not-with-placeholder": "<input placeholder=a aria-placeholder=b>",
    "aria-valuemin.not-with-min": "<input type=range min=1 aria-valuemin=1>",
    "aria-valuemax.not-with-max": "<input type=range max=1 aria-valuemax=1>",
    "aria-valuemax.on-meter": "<meter aria-valuemax=1>x</meter>",
    "aria-valuemin.on-meter": "<meter aria-valuemin=1>x</meter>",
    "aria-valuemin-on-meter.forbidden": "<meter aria-valuemin=1>x</meter>",
    "aria-valuemax.on-progress": "<progress aria-valuemax=1>x</progress>",
    "aria-valuemin.on-progress": "<progress aria-valuemin=1>x</progress>",
    "aria-valuemax.on-input-number": "<input type=number aria-valuemax=1>",
    "aria-valuemin.on-input-number": "<input type=number aria-valuemin=1>",
    "aria-checked.on-implicit-checkbox-radio": "<input type=checkbox aria-checked=true>",
    "aria-checked.on-input-type": "<input type=text aria-checked=true>",
    "checkbox.role-button-needs-aria-pressed": "<input type=checkbox role=button>",
    "presentational.no-heading-in-button": "<div role=button><h2>x</h2></div>",
    "presentational.no-button-in-img": "<div role=img><button>x</button></div>",
    "aria.input-hidden-no-aria-attrs": "<input type=hidden aria-label=x>",
    "aria-hidden-restrictions.not-on-hidden-input": "<input type=hidden aria-hidden=true>",
    "aria.none-role-global-aria-ignored": "<b role=none aria-details=x>x</b>",
    "aria.none-role-tabindex-ignored": "<b role=none tabindex=0>x</b>",
    "aria.option-no-aria-selected": "<select><option aria-selected=true>x</option></select>",
    "aria.label-hidden-labelable-descendant": "<label aria-hidden=true><input></label>",
    "aria.img-alt-role-none-presentation": "<img alt=x role=none>",
    "aria.active-tab-needs-tabpanel": "<b role=tab aria-selected=true aria-controls=q>x</b><i id=q>x</i>",
    "naming-prohibited.no-aria-label": "<div aria-label=x></div>",
    "naming-prohibited.no-aria-labelledby": "<a aria-labelledby=x>y</a>",
    "naming-prohibited.no-aria-braillelabel": "<x-y aria-braillelabel=x></x-y>",
    "role-forbidden-inside-heading.not-in-heading": "<h2><b role=note>x</b></h2>",
    "a-href-forbidden-inside-widget-role.descendant": "<div role=tab><a href=x>y</a></div>",
    "tabindex-forbidden-inside-role.descendant": "<div role=tab><b tabindex=0>y</b></div>",
    "unnecessary-role-extra.link": "<a href=x role=link>y</a>",
    "select-listbox-role.requires-multiple-or-size": "<select role=listbox><option>x</option></select>",
    "select-listbox-role.redundant": "<select role=listbox size=3><option>x</option></select>",
    "multiple-main-with-role.at-most-one-visible": "<main>x</main><div role=main>y</div>",
    "a-href-aria-disabled.true": "<a href=x aria-disabled=true>y</a>",
    "aria-disabled-redundant.on-disabled": "<input disabled aria-disabled=true>",
    "aria-expanded-restrictions.not-with-command": "<button aria-expanded=true command=x>y</button>",
    "aria-expanded-restrictions.not-with-popovertarget": "<button aria-expanded=true popovertarget=x>y</button>",
    "aria-hidden-restrictions.not-true-with-hidden-until-found": "<p hidden=until-found aria-hidden=true>x</p>",
    "aria-valuemax-on-max.forbidden": "<input type=range max=3 aria-valuemax=3>",
    "role-listitem-aria-level.forbidden": "<b role=listitem aria-level=2>x</b>",
    "dl-div-child-role.presentation-or-none": "<dl><div role=group><dt>x<dd>y</div></dl>",
    "summary-role.forbidden": "<details><summary role=button>x</summary>y</details>",
    "label-role-restrictions.role-forbidden": "<label role=note for=q>x</label><input id=q>",
    "label-role-restrictions.aria-label-forbidden-when-for": "<label aria-label=y for=q>x</label><input id=q>",
    "role-cell-containment.needs-row-ancestor": "<b role=cell>x</b>",
    "role-option-containment.needs-listbox-ancestor": "<b role=option id=q>x</b><i role=list aria-owns=q>y</i>",
    "role-row-containment.needs-table-family-ancestor": "<b role=row>x</b>",
    "li-role-by-ancestor.listbox-or-list": "<ul role=listbox><li role=button>x</ul>",
    "li-role-by-ancestor.menu-or-menubar": "<ul role=menu><li role=button>x</ul>",
    "li-role-by-ancestor.tablist": "<ul role=tablist><li role=button>x</ul>",
    "li-role-by-ancestor.tree": "<ul role=tree><li role=button>x</ul>",
    "aria.hidden-not-focusable": "<b aria-hidden=true tabindex=0>x</b>",
    "aria.multiselectable-on-select": "<select aria-multiselectable=true><option>x</option></select>",
    "attributes.lang-xml-lang-sameness": "<p lang=en xml:lang=de>x</p>",
    "headingoffset-range.zero-to-eight": "<p headingoffset=9>x</p>",
    "commandfor-target-exists.id-found": "<button commandfor=q>x</button>",
    "aria-activedescendant-target-exists.id-found": "<input aria-activedescendant=q>",
    "attributes.form-ref-form": "<input form=q><p id=q>x</p>",
    "headings.empty": "<h2> </h2>",
    "headings.article-lacks-heading": "<article>x</article>",
    "headings.section-lacks-heading": "<section>x</section>",
    "headings.no-top-level": "<h2>x</h2>",
    "headings.skip-level-h1-to-h3": "<h1>x</h1><h3>y</h3>",
    "ids.duplicate": "<p id=q>x</p><p id=q>y</p>",
    "microdata.itemid-without-itemtype": "<p itemid=x itemscope>y</p>",
    "microdata.itemref-without-itemscope": "<p itemref=x>y</p>",
    "microdata.itemtype-without-itemscope": "<p itemtype=x>y</p>",
    "obsolete-elements.deprecated": "<center>x</center>",
    "tables.th-scope-enum": "<table><tr><th scope=x>y</table>",
    "tables.colspan-max": "<table><tr><td colspan=1001>y</table>",
    "tables.rowspan-max": "<table><tr><td rowspan=65535>y</table>",
    "tables.span-max": "<table><colgroup span=1001></colgroup></table>",
    "tables.td-role-in-table": "<table><tr><td role=cell>x</table>",
    "tables.headers-ref-th": "<table><tr><th id=q>x</table><table><tr><td headers=q>x</table>",
    "tables.row-no-cells": "<table><tr></tr></table>",
    "tables.row-width-not-less-than-column-markup": "<table><colgroup><col><col span=2></colgroup><tr><td>x</table>",
    "tables.row-width-not-exceeding-column-markup": "<table><colgroup></colgroup><tr><td colspan=2>x</table>",
    "tables.row-width-not-less-than-first-row": "<table><tr><td>x<td>y<tr><td>z</table>",
    "tables.row-width-not-exceeding-first-row": "<table><tr><td>x<tr><td>z<td>y</table>",
    "elements.bdo-missing-dir": "<bdo>x</bdo>",
    "elements.bdo-dir-auto": "<bdo dir=auto>x</bdo>",
    "elements.area-outside-map": "<area>",
    "elements.main-in-wrong-ancestor": "<nav><main>x</main></nav>",
    "elements.multiple-main-visible": "<main>x</main><main>y</main>",
    "elements.map-id-name-mismatch": "<map id=x name=y></map>",
    "elements.link-missing-href": "<link rel=stylesheet>",
    "elements.link-preload-missing-as": "<link rel=preload href=x>",
    **{f"elements.script-importmap-{n}": f"<script type=importmap {n}></script>" for n in ("async", "defer", "src", "integrity")},
    "elements.script-speculationrules-integrity": "<script type=speculationrules integrity=x></script>",
    "elements.script-module-defer": "<script type=module defer src=x></script>",
    "elements.script-module-inline-integrity": "<script type=module integrity=x></script>",
    "elements.script-module-nomodule": "<script type=module nomodule></script>",
    "elements.script-classic-inline-integrity": "<script integrity=x></script>",
    "elements.script-datablock-integrity": "<script type=text/plain integrity=x></script>",
    "elements.link-integrity-rel": "<link rel=icon href=x integrity=y>",
    "elements.select-multiple-selected": "<select><option selected>x<option selected>y</select>",
    "elements.track-empty-label": "<video><track label=''></video>",
    "elements.track-multiple-default": "<video><track default><track default></video>",
    "elements.input-button-empty-value": "<input type=button value=' '>",
    "elements.selectedcontent-no-aria-hidden": "<select><button><selectedcontent aria-hidden=true></selectedcontent></button></select>",
    "elements.selectedcontent-no-role": "<select><button><selectedcontent role=x></selectedcontent></button></select>",
    "elements.autofocus-multiple": "<input autofocus><p><input autofocus></p>",
    "elements.meter-min-max": "<meter min=2 max=1>x</meter>",
    "elements.meter-value-min": "<meter min=2 max=3 value=1>x</meter>",
    "elements.meter-value-no-min": "<meter value=-1>x</meter>",
    "elements.meter-value-max": "<meter max=2 value=3>x</meter>",
    "elements.meter-value-no-max": "<meter value=2>x</meter>",
    "elements.meter-low-min": "<meter min=2 max=3 low=1>x</meter>",
    "elements.meter-low-high": "<meter max=9 low=3 high=2>x</meter>",
    "elements.meter-low-max": "<meter max=2 low=3>x</meter>",
    "elements.meter-high-max": "<meter max=2 high=3>x</meter>",
    "elements.meter-high-min": "<meter min=2 max=3 high=1>x</meter>",
    "elements.meter-optimum-min": "<meter min=2 max=3 optimum=1>x</meter>",
    "elements.meter-optimum-max": "<meter max=2 optimum=x>x</meter>",
    "elements.progress-value-max": "<progress max=2 value=3>x</progress>",
    "elements.progress-value-no-max": "<progress value=2>x</progress>",
    "elements.input-readonly-type": "<input type=checkbox readonly>",
    "elements.input-maxlength-type": "<input type=date maxlength=2>",
    "elements.input-required-types": "<input type=range required>",
    "elements.input-list-ref": "<input list=q><p id=q>x</p>",
    "elements.link-as-missing-rel": "<link as=image href=x rel=icon>",
    "elements.link-imagesrcset-as": "<link imagesrcset=x rel=preload as=font imagesizes=x>",
    "elements.label-max-one-labelable": "<label><input><input></label>",
    "elements.srcset-w-needs-sizes": "<img alt=x srcset='a 10w'>",
    "elements.source-media-not-all": "<picture><source media=' ALL '></picture>",
    "elements.srcset-sizes-needs-w-descriptor": "<img alt=x srcset='a 2x' sizes=1px>",
    "elements.source-needs-media-or-type": "<picture><source srcset=a><img alt=x srcset=b></picture>",
    "elements.custom-element-no-is": "<x-y is=z></x-y>",
    "elements.form-accept-charset-utf8": "<form accept-charset=latin1></form>",
    "elements.link-imagesrcset-w-needs-imagesizes": "<link rel=preload as=image imagesrcset='a 10w'>",
    "elements.meta-charset-unique": "<meta charset=utf-8><meta charset=utf-8>",
    "elements.meta-charset-no-content-type": "<meta charset=utf-8><meta http-equiv=Content-Type>",
    "elements.meta-media-needs-theme-color": "<meta media=x name=y>",
    "elements.meta-x-ua-compatible-ie-edge": "<meta http-equiv=X-UA-Compatible content=IE=9>",
    "elements.select-button-allowed-only-dropdown": "<select multiple><button>x</button></select>",
    "elements.select-button-no-aria-label": "<select><button aria-label=y>x</button></select>",
    **{f"elements.dt-no-{t}": f"<dl><dt><p></p><{t}>x</{t}><dd>y</dl>" for t in "h1 h2 h3 h4 h5 h6 header hgroup nav section".split()},
    "elements.dt-no-footer-or-header": "<dl><dt><footer>x</footer><dd>y</dl>",
    "elements.base-before-link-script": "<link rel=icon href=x><base href=y>",
    "elements.script-inline-no-async-defer": "<script async></script>",
    "elements.script-inline-classic-no-blocking": "<script blocking=render></script>",
    "elements.script-inline-classic-no-fetchpriority": "<script fetchpriority=low></script>",
    "elements.script-inline-module-no-blocking": "<script type=module blocking=render></script>",
    "elements.script-inline-module-no-fetchpriority": "<script type=module fetchpriority=low></script>",
    "elements.script-type-text-javascript-unnecessary": "<script type=application/javascript></script>",
    "elements.script-type-text-javascript-warning": "<script type=text/javascript></script>",
    "elements.source-sizes-auto-lazy": "<picture><source sizes=auto srcset='a 1w'><img alt=x></picture>",
    "elements.img-sizes-auto-lazy": "<img alt=x sizes=AUTO srcset='a 1w'>",
    "elements.sizes-needs-srcset": "<img alt=x sizes=1px>",
    "elements.img-controls-needs-alt": "<img controls alt=''>",
    "elements.input-hidden-no-autocomplete-on-off": "<input type=hidden autocomplete=OFF>",
    "elements.input-pattern-types": "<input type=number pattern=x>",
    "elements.input-formaction-types": "<input formaction=x>",
    "elements.script-importmap-no-crossorigin": "<script type=importmap crossorigin></script>",
    "elements.script-importmap-no-blocking": "<script type=importmap blocking></script>",
    "elements.script-importmap-no-fetchpriority": "<script type=importmap fetchpriority=low></script>",
    "elements.script-importmap-no-nomodule": "<script type=importmap nomodule></script>",
    "elements.script-language-obsolete": "<script language=js></script>",
    "elements.option-empty-needs-label": "<select><option> </option></select>",
    "elements.label-for-non-form-control": "<label for=q>x</label><p id=q>y</p>",
    "elements.label-for-descendant-matching-id": "<label for=q>x<input id=r></label>",
    "elements.script-speculationrules-no-disallowed-attrs": "<script type=speculationrules nonce=x></script>",
    "elements.script-speculationrules-no-blocking": "<script type=speculationrules blocking></script>",
    "elements.script-speculationrules-no-fetchpriority": "<script type=speculationrules fetchpriority=low></script>",
    "elements.script-speculationrules-no-nomodule": "<script type=speculationrules nomodule></script>",
    "elements.no-footer-in-header-footer": "<header><footer>x</footer></header>",
    "elements.no-header-in-header-footer": "<header><header>x</header></header>",
    "elements.dl-duplicate-dt": "<dl><dt>a<dd>b<dt> a <dd>c</dl>",
    "elements.ruby-tabular-rb": "<ruby><rb>a<rb>b<rt>c<rt>d</ruby>",
    "elements.rtc-positioning": "<ruby>a<rtc>b</rtc></ruby>",
    "elements.source-srcset-w-needs-sizes": "<picture><source srcset='a 9W'><img alt=x></picture>",
    "elements.img-picture-srcset-w-needs-sizes": "<picture><img alt=x srcset='a 9w'></picture>",
    "elements.script-datablock-no-async": "<script type=text/plain async></script>",
    "elements.link-color-needs-mask-icon": "<link rel=icon href=x color=red>",
    "elements.link-disabled-needs-stylesheet": "<link rel=icon href=x disabled>",
    "elements.link-sizes-allowed-rel": "<link rel=preconnect href=x sizes=any>",
    "elements.link-in-body-rel": "<body><link rel=icon href=x>",
    "elements.link-modulepreload-as-invalid": "<link rel=modulepreload href=x as=font>",
    "elements.link-preload-as-invalid": "<link rel=preload href=x as=json>",
    "elements.input-name-isindex-forbidden": "<input name=IsIndex>",
    "elements.img-ismap-needs-a-href": "<img alt=x ismap>",
    "elements.img-usemap-target-exists": "<img alt=x usemap='#m'><map name=n></map>",
    "elements.select-required-needs-option": "<select required></select>",
    "elements.select-required-first-option-placeholder": "<select required><option value=a>x</option></select>",
    "elements.select-autocomplete-no-webauthn": "<select autocomplete='x webauthn'></select>",
    "elements.address-no-nested-address": "<address><b><address>x</address></b></address>",
    "elements.figure-figcaption-no-role": "<figure role=img><figcaption>x</figcaption></figure>",
    "elements.figure-table-caption-should-be-figcaption": "<figure><table><caption>x</caption><tr><td>y</table><figcaption>x</figcaption></figure>",
    "elements.link-alternate-stylesheet-needs-title": "<link rel='alternate stylesheet' href=x>",
    "elements.link-blocking-needs-stylesheet": "<link rel=icon href=x blocking=render>",
    "elements.link-imagesizes-needs-imagesrcset": "<link rel=preload as=image href=x imagesizes=1px>",
    "elements.meta-multiple-description": "<meta name=description content=x><meta name=description content=y>",
    "elements.meta-viewport-user-scalable-no": "<meta name=viewport content='user-scalable=NO'>",
    "elements.optgroup-no-label-no-legend": "<select><optgroup><option>x</optgroup></select>",
    "elements.title-not-empty": "<title> </title>",
    "elements.audio-controls-in-button": "<button><audio controls></audio></button>",
    "elements.itemprop-needs-itemscope": "<p itemprop=x>y</p>",
    "elements.itemref-target-exists": "<p itemscope itemref='nonexistent'>y</p>",
    "elements.img-missing-alt": "<img src=x>",
    "elements.img-missing-alt-in-figure": "<figure><img src=x></figure>",
    "elements.a-href-in-button": "<button><a href=x>y</a></button>",
    "elements.svg-a-in-svg-a": "<svg><a><g><a></a></g></a></svg>",
    "elements.a-href-in-a": "<a><b><a href=x>y</a></b></a>",
    "elements.a-in-a": "<a><b><a>y</a></b></a>",
    **{f"elements.{t}-in-a": f"<a href=x><{t}>y</{t}></a>" for t in HIDING.split()},
    "elements.dialog-in-a": "<a href=x><dialog>y</dialog></a>",
    "elements.video-controls-in-a": "<a href=x><video controls></video></a>",
    "elements.audio-controls-in-a": "<a href=x><audio controls></audio></a>",
    "elements.img-usemap-in-a": "<a href=x><img alt=x usemap='#'></a>",
    "elements.object-usemap-in-a": "<a href=x><object usemap='#'></object></a>",
    "elements.input-in-a": "<a href=x><input></a>",
    "elements.tabindex-in-a": "<a href=x><b tabindex=0>y</b></a>",
    "elements.interactive-role-in-a": "<a href=x><b role='button x'>y</b></a>",
    "elements.input-autocomplete-webauthn-alone": "<input autocomplete=' webauthn '>",
    "elements.meta-charset-not-utf8": "<meta charset=latin1>",
    **{f"roles.unnecessary-{r}": f"<{t} role={r}>x</{t}>" for r, t in assertions.IMPLIED.items()},
    **{f"unnecessary-role-extra.{r}": f"<{assertions.IMPLIED[r]} role={r}>x" for r in ("dialog", "figure", "deletion", "button", "rowgroup", "listitem")},
    "roles.unnecessary-banner": "<header role=banner>x</header>",
    "roles.unnecessary-contentinfo": "<footer role=contentinfo>x</footer>",
    "roles.unnecessary-list": "<ol role=list></ol>",
    "roles.unnecessary-spinbutton": "<input type=number role=spinbutton>",
    "roles.unnecessary-textbox": "<input role=textbox>",
    "roles.unnecessary-searchbox": "<input type=search role=searchbox>",
    "roles.unnecessary-combobox": "<select role=combobox><option>x</select>",
    "roles.unnecessary-listbox": "<select multiple role=listbox><option>x</select>",
    "roles.unnecessary-link": "<a href=x role=link>y</a>",
    "roles.unnecessary-math": "<math role=math></math>",
    "roles-properties-global.aria-hidden-on-body": "<body aria-hidden=true>",
    "elements.html-missing-lang": "<html><body>x",
}


def whole_page(fragment: str) -> str:
    """A page around a fragment that breaks nothing else of what the fragment is about."""
    if fragment.startswith(("<body", "<html", "<!doctype")):
        return fragment if fragment.startswith(("<html", "<!doctype")) else f"<html lang=en>{fragment}"
    return f"<html lang=en><main><h1>t</h1></main>{fragment}" if "<h1" not in fragment and "main" not in fragment and fragment != "<h2>x</h2>" else f"<html lang=en><body>{fragment}"


#: Rule on structure: markup that breaks it, outcome, severity.
STRUCTURE = {
    "document/lang-missing": ("<html><body>x", "fail", "high"),
    "document/lang-invalid": ("<html lang='??'><body>x", "fail", "medium"),
    "document/lang-mismatch": ("<html lang=en xml:lang=de><body>x", "fail", "medium"),
    "document/title-missing": ("<html lang=en><body>x", "fail", "high"),
    "document/title-empty": ("<html lang=en><head><title> </title></head><body><svg><title>x</title></svg>", "fail", "high"),
    "zoom/viewport-locked": ("<meta name=viewport content='user-scalable=no'>", "fail", "high"),
    "zoom/viewport-scale-limited": ("<meta name=viewport content='maximum-scale=3'>", "best_practice", "low"),
    "zoom/viewport-missing": ("<html lang=en><body>x", "best_practice", "high"),
    "headings/empty": ("<h2> </h2>", "fail", "medium"),
    "headings/skip-level": ("<h1>a</h1><h3>b</h3>", "best_practice", "medium"),
    "headings/h1-missing": ("<html lang=en><body><h2>a</h2>", "best_practice", "medium"),
    "headings/h1-multiple": ("<h1>a</h1><h1>b</h1>", "review", "low"),
    "headings/none": ("<html lang=en><body><nav><a href=/x>y</a></nav>text", "fail", "medium"),
    "images/alt-missing": ("<img src=x>", "fail", "high"),
    "images/alt-suspicious": ("<img src=x alt=photo.jpg>", "review", "medium"),
    "images/area-alt-missing": ("<map name=m><area href=x></map>", "fail", "high"),
    "images/input-alt-missing": ("<input type=image>", "fail", "high"),
    "images/server-side-map": ("<a href=x><img alt=abc ismap></a>", "review", "medium"),
    "objects/alt-missing": ("<object></object>", "fail", "high"),
    "forms/label-missing": ("<input>", "fail", "critical"),
    "forms/placeholder-as-label": ("<input placeholder=x>", "review", "medium"),
    "forms/error-unidentified": ("<input aria-label=x aria-invalid=true>", "review", "medium"),
    "forms/group-missing": ("<label><input type=radio name=a>x</label><label><input type=radio name=a>y</label>", "review", "medium"),
    "forms/no-submit": ("<form><label>x<input></label></form>", "review", "medium"),
    "context/on-input": ("<select aria-label=x onchange='this.form.submit()'></select>", "review", "medium"),
    "forms/autocomplete-invalid": ("<label>x<input autocomplete='work name'></label>", "fail", "low"),
    "context/autofocus": ("<button autofocus>x</button>", "review", "medium"),
    "forms/redundant-entry": ("<form><label>E-Mail <input name=a></label><input name=email></form>", "review", "medium"),
    "context/on-focus": ("<input aria-label=x onfocus='location=1'>", "review", "high"),
    "auth/captcha": ("<div class=g-recaptcha></div>", "review", "medium"),
    "aria/role-abstract": ("<b role='widget button'>x</b>", "fail", "high"),
    "aria/role-invalid": ("<b role=nonsense>x</b>", "fail", "high"),
    "aria/required-attribute-missing": ("<b role=slider tabindex=0>x</b>", "fail", "high"),
    "aria/attribute-unknown": ("<b aria-foo=x>y</b>", "fail", "high"),
    "aria/attribute-value-invalid": ("<b role=checkbox aria-checked=yes>x</b>", "fail", "high"),
    "aria/presentation-conflict": ("<b role=none aria-label=x>y</b>", "fail", "medium"),
    "aria/presentational-children-focusable": ("<button><a href=x>y</a></button>", "fail", "high"),
    "aria/reference-missing": ("<b aria-describedby=nowhere>x</b>", "fail", "high"),
    "aria/combobox-popup-missing": ("<input role=combobox aria-expanded=true aria-label=x>", "fail", "medium"),
    "aria/owns-conflict": ("<b aria-owns=q>x</b><i aria-owns=q>y</i><u id=q>z</u>", "fail", "high"),
    "aria/tab-selected-missing": ("<div role=tablist><b role=tab>x</b></div><p role=tabpanel>y</p>", "review", "medium"),
    "aria/tabpanel-missing": ("<div role=tablist><b role=tab aria-selected=true>x</b></div>", "review", "low"),
    "popover/target-missing": ("<button popovertarget=q>x</button>", "fail", "medium"),
    "popover/target-invalid": ("<button popovertarget=q>x</button><p id=q>y</p>", "fail", "medium"),
    "inert/dialog-inert": ("<dialog open inert>x</dialog>", "fail", "high"),
    "ids/duplicate": ("<label for=q>x</label><input id=q><b id=q>y</b>", "review", "medium"),
    "keyboard/positive-tabindex": ("<b tabindex=3>x</b>", "review", "high"),
    "keyboard/hidden-focusable": ("<div aria-hidden=true><button>x</button></div>", "fail", "high"),
    "keyboard/click-handler-not-focusable": ("<div onclick=x()>y</div>", "review", "high"),
    "keyboard/skip-link-missing": ("<html lang=en><body><nav><a href=/x>y</a></nav><main><h1>t</h1></main>", "review", "medium"),
    "links/used-as-button": ("<a href='#' onclick=x()>y</a>", "review", "low"),
    "lists/invalid-structure": ("<ul><div>x</div></ul>", "fail", "medium"),
    "lists/empty": ("<ul></ul>", "best_practice", "low"),
    "lists/item-outside-list": ("<div><li>x</li></div>", "fail", "medium"),
    "lists/term-without-definition": ("<dl><dt>x</dt></dl>", "fail", "medium"),
    "tables/header-missing": ("<table><caption>c</caption><tr><td>x</table>", "review", "high"),
    "tables/name-missing": ("<table><tr><th>x<td>y</table>", "review", "low"),
    "tables/presentational-with-headers": ("<table role=none><tr><th>x</table>", "fail", "medium"),
    "tables/header-without-data": ("<table><caption>c</caption><tr><th>x</table>", "fail", "high"),
    "tables/data-undetermined": ("<table><caption>c</caption><thead><tr><th>x</thead><tbody></tbody></table>", "untested", "high"),
    "tables/headers-attr-invalid": ("<table><tr><th id=a>x<td headers=b>y</table>", "fail", "high"),
    "landmarks/main-missing": ("<html lang=en><body>text", "best_practice", "high"),
    "landmarks/main-duplicate": ("<html lang=en><body><main>x</main><main>y</main>", "best_practice", "high"),
    "landmarks/navigation-missing": ("<html lang=en><body>text", "review", "low"),
    "landmarks/banner-missing": ("<html lang=en><body>text", "review", "low"),
    "landmarks/contentinfo-missing": ("<html lang=en><body>text", "review", "low"),
    "navigation/location-missing": ("<nav><a href=/x>y</a></nav>", "review", "low"),
    "media/audio-autoplay": ("<audio autoplay src=x.mp3></audio>", "review", "medium"),
    "media/video-captions-missing": ("<video controls></video>", "review", "medium"),
    "viz/text-missing": ("<figure data-viz=chart><figcaption>x</figcaption><table><tr><td>1</table></figure>", "fail", "high"),
    "viz/caption-missing": ("<figure data-viz=x><p data-viz-text>y</p></figure>", "fail", "low"),
    "viz/static-missing": ("<figure data-viz=3d><p data-viz-text>y</p></figure>", "fail", "medium"),
    "viz/table-missing": ("<figure data-viz=chart><p data-viz-text>y</p></figure>", "review", "low"),
    "display/toggle-missing": ("<figure data-viz=x><p data-viz-text>y</p></figure>", "fail", "medium"),
    "display/init-missing": ("<figure data-viz=x><p data-viz-text>y</p></figure>", "review", "low"),
    "display/text-hidden": ("<figure data-viz=x><p data-viz-text aria-hidden=true>y</p></figure>", "fail", "high"),
    "language/part-invalid": ("<p lang='??'>x</p>", "fail", "medium"),
    "language/part-unmarked": ("<p>Der Hund und die Katze sind mit der Maus auf dem Dach und das ist für alle nicht gut, aber auch die Vögel werden von der Leiter auf eine Bank gesetzt und so weiter</p>", "review", "medium"),
    "language/part-undetermined": ("<html lang=fr><body>x", "untested", "medium"),
    "language/abbreviation-unexpanded": ("<abbr>x</abbr>", "review", "low"),
    "timing/meta-refresh": ("<meta http-equiv=refresh content='5; url=x'>", "fail", "high"),
    "timing/meta-refresh-enhanced": ("<meta http-equiv=refresh content=80000>", "fail", "medium"),
    "headings/section-without-heading": ("<article>x</article>", "review", "low"),
    "aria/role-redundant": ("<nav role=navigation>x</nav>", "best_practice", "low"),
    "patterns/tooltip-unreferenced": ("<b role=tooltip id=q>x</b>", "best_practice", "low"),
    "manual/media-alternatives": ("<video></video>", "untested", "high"),
    "manual/image-alternatives": ("<img alt=abc>", "untested", "high"),
    "manual/visual-structure": ("<p>x</p>", "untested", "medium"),
    "manual/use-of-color": ("<a href=x>y</a>", "untested", "medium"),
    "manual/timing": ("<meta http-equiv=refresh content=0>", "untested", "high"),
    "manual/error-handling": ("<textarea></textarea>", "untested", "high"),
    "manual/authentication": ("<input type=password>", "untested", "high"),
    "manual/pointer-gestures": ("<div class=swiper-slide>x</div>", "untested", "medium"),
    "manual/no-timing": ("<select></select>", "untested", "low"),
    "manual/interruptions": ("<p role=alert>x</p>", "untested", "low"),
    "manual/re-authenticating": ("<input type=password>", "untested", "low"),
    "manual/unusual-words": ("<p>x</p>", "untested", "low"),
    "manual/help": ("<input>", "untested", "low"),
    "manual/dragging-movements": ("<p draggable=true>x</p>", "untested", "medium"),
    "manual/consistent-help": ("<p>x</p>", "untested", "low"),
    "manual/keyboard-trap": ("<dialog>x</dialog>", "untested", "high"),
    "manual/character-shortcuts": ("<p accesskey=x>y</p>", "untested", "medium"),
    "manual/error-prevention": ("<input>", "untested", "medium"),
    "manual/pointer-cancellation": ("<p onmousedown=x()>y</p>", "untested", "medium"),
    "manual/consistent-navigation": ("<a href=x>y</a>", "untested", "medium"),
    "manual/consistent-identification": ("<a href=x>y</a>", "untested", "medium"),
    "manual/sensory-characteristics": ("<p>x</p>", "untested", "medium"),
    "manual/multiple-ways": ("<a href=x>y</a>", "untested", "medium"),
    "manual/text-spacing": ("<p>x</p>", "untested", "medium"),
    "manual/content-on-hover-focus": ("<p popover>x</p>", "untested", "medium"),
    "manual/motion-actuation": ("<script>addEventListener('devicemotion', f)</script>", "untested", "medium"),
}
#: Rule on roles and names: markup that breaks it, outcome, severity.
SEMANTICS = {
    "links/name-missing": ("<a href=x></a>", "fail", "critical"),
    "buttons/name-missing": ("<button></button>", "fail", "critical"),
    "svg/name-missing": ("<svg role=img></svg>", "fail", "high"),
    "links/ambiguous-name": ("<a href=x>same</a><a href=y>same</a>", "review", "medium"),
    "links/generic-name": ("<div><a href=x>click here</a></div>", "review", "medium"),
    "links/url-name": ("<div><a href=x>www.example.com</a></div>", "review", "low"),
    "links/single-character-name": ("<a href=x>x</a>", "review", "medium"),
    "links/new-window-unannounced": ("<a href=x target=_blank>words</a>", "review", "low"),
    "links/purpose-link-only": ("<p>see <a href=x>here</a></p>", "review", "low"),
    "aria/attribute-not-allowed": ("<div role=img aria-label=x aria-checked=true></div>", "fail", "high"),
    "aria/attribute-prohibited": ("<p aria-label=x>y</p>", "fail", "high"),
    "aria/required-parent-missing": ("<div role=option>x</div>", "fail", "high"),
    "aria/required-children-missing": ("<div role=list><p>x</p></div>", "fail", "high"),
    "names/required-missing": ("<div role=checkbox></div>", "fail", "critical"),
    "names/symbol-only": ("<button aria-label='+'>x</button>", "review", "medium"),
    "names/title-only": ("<button title=x></button>", "review", "medium"),
    "dialog/name-missing": ("<dialog open><button>x</button></dialog>", "fail", "high"),
    "dialog/modal-unmarked": ("<div role=dialog aria-label=x><button>x</button></div>", "review", "medium"),
    "dialog/focusable-missing": ("<dialog open aria-label=x>y</dialog>", "review", "medium"),
    "summary/name-missing": ("<details><summary></summary>x</details>", "fail", "high"),
    "status/live-overridden": ("<p role=alert aria-live=off>x</p>", "fail", "high"),
    "label-in-name/mismatch": ("<button aria-label=send>search</button>", "fail", "medium"),
    "forms/group-name-missing": ("<fieldset><input></fieldset>", "review", "medium"),
    "forms/title-only-label": ("<input title=x>", "review", "medium"),
    "forms/required-unmarked": ("<label>name <input required></label>", "review", "medium"),
    "forms/instructions-missing": ("<label>x<input pattern=y></label>", "review", "medium"),
    "landmarks/not-unique": ("<nav>x</nav><nav>y</nav>", "review", "medium"),
    "landmarks/not-top-level": ("<html lang=en><body><nav><main>x</main></nav>", "best_practice", "medium"),
    "landmarks/banner-duplicate": ("<header>x</header><header>y</header>", "best_practice", "medium"),
    "landmarks/contentinfo-duplicate": ("<footer>x</footer><footer>y</footer>", "best_practice", "medium"),
    "landmarks/content-outside": ("<html lang=en><body><main>x</main><p>y</p>", "best_practice", "medium"),
    "keyboard/focusable-no-role": ("<div tabindex=0>x</div>", "review", "low"),
    "keyboard/interactive-not-focusable": ("<div role=button>x</div>", "review", "high"),
    "patterns/accordion-controls-missing": ("<button aria-expanded=true>x</button>", "review", "low"),
    "frames/name-missing": ("<iframe></iframe>", "fail", "high"),
}
#: All that the semantic rules find on a page: markup, then rule@node for each finding (with outcome and severity where they aren't those above). The last ones look alike and break nothing.
WHOLE_PAGES = [
    ("<a href=x></a>", "links/name-missing@4"), ("<button></button>", "buttons/name-missing@4"), ("<svg role=img></svg>", "svg/name-missing@4"),
    ("<a href=x>same</a><a href=y>same</a>", "landmarks/content-outside@4 landmarks/content-outside@6 links/ambiguous-name@4 links/ambiguous-name@6"), ("<div><a href=x>click here</a></div>", "landmarks/content-outside@4 links/generic-name@5 links/purpose-link-only@5"),
    ("<div><a href=x>www.example.com</a></div>", "landmarks/content-outside@4 links/url-name@5"), ("<a href=x>x</a>", "landmarks/content-outside@4 links/single-character-name@4"), ("<a href=x target=_blank>words</a>", "landmarks/content-outside@4 links/new-window-unannounced@4"),
    ("<p>see <a href=x>here</a></p>", "landmarks/content-outside@4 links/generic-name:review:low@6 links/purpose-link-only@6"), ("<div role=img aria-label=x aria-checked=true></div>", "aria/attribute-not-allowed@4 landmarks/content-outside@4"), ("<p aria-label=x>y</p>", "aria/attribute-prohibited@4 landmarks/content-outside@4"),
    ("<div role=option>x</div>", "aria/required-parent-missing@4 keyboard/interactive-not-focusable@4 landmarks/content-outside@4"), ("<div role=list><p>x</p></div>", "aria/required-children-missing@4 landmarks/content-outside@4"), ("<div role=checkbox></div>", "keyboard/interactive-not-focusable@4 names/required-missing@4"),
    ("<button aria-label='+'>x</button>", "landmarks/content-outside@4 names/symbol-only@4"), ("<button title=x></button>", "landmarks/content-outside@4 names/title-only@4"), ("<dialog open><button>x</button></dialog>", "dialog/name-missing@4 landmarks/content-outside@4"),
    ("<div role=dialog aria-label=x><button>x</button></div>", "dialog/modal-unmarked@4 landmarks/content-outside@4"), ("<dialog open aria-label=x>y</dialog>", "dialog/focusable-missing@4 landmarks/content-outside@4"), ("<dialog open aria-label=x><button disabled>y</button></dialog>", "dialog/focusable-missing@4 landmarks/content-outside@4"),
    ("<details><summary></summary>x</details>", "landmarks/content-outside@4 summary/name-missing@5"), ("<p role=alert aria-live=off>x</p>", "landmarks/content-outside@4 status/live-overridden@4"), ("<button aria-label=send>search</button>", "label-in-name/mismatch@4 landmarks/content-outside@4"),
    ("<fieldset><input></fieldset>", "forms/group-name-missing@4"), ("<input title=x>", "forms/title-only-label@4 landmarks/content-outside@4"), ("<label>name <input required></label>", "forms/required-unmarked@6 landmarks/content-outside@4"), ("<label>x<input pattern=y></label>", "forms/instructions-missing@6 landmarks/content-outside@4"),
    ("<nav>x</nav><nav>y</nav>", "landmarks/not-unique@4 landmarks/not-unique@6"), ("<html lang=en><body><nav><main>x</main></nav>", "landmarks/not-top-level@3"), ("<header>x</header><header>y</header>", "landmarks/banner-duplicate@6 landmarks/not-unique@4 landmarks/not-unique@6"),
    ("<footer>x</footer><footer>y</footer>", "landmarks/contentinfo-duplicate@6 landmarks/not-unique@4 landmarks/not-unique@6"), ("<html lang=en><body><main>x</main><p>y</p>", "landmarks/content-outside@4"), ("<div tabindex=0>x</div>", "keyboard/focusable-no-role@4 landmarks/content-outside@4"),
    ("<div role=button>x</div>", "keyboard/interactive-not-focusable@4 landmarks/content-outside@4"), ("<button aria-expanded=true>x</button>", "landmarks/content-outside@4 patterns/accordion-controls-missing@4"), ("<iframe></iframe>", "frames/name-missing@4"),
    ("<span role=link>x</span><span role=link tabindex=0></span>", "keyboard/interactive-not-focusable@4 landmarks/content-outside@4 links/single-character-name@4"), ("<a href=x role=button aria-label=''></a>", "buttons/name-missing@4 links/name-missing@4"),
    ("<a href=x#1>same</a><a href=x#2>same</a><a href=x#1>other</a>", "landmarks/content-outside@4 landmarks/content-outside@6 landmarks/content-outside@8 links/ambiguous-name@4 links/ambiguous-name@6"),
    ("<iframe width=1 height=0></iframe><iframe style='color:red; display : none'></iframe><iframe aria-labelledby=nowhere></iframe><iframe title=t></iframe><iframe tabindex=-1></iframe>", "frames/name-missing@6"),
    ("<html lang=en><body><a href='#m'>skip</a>bare words<main id=m>x</main></body>", "landmarks/content-outside@1"), ("<html lang=en><body><a href=/x>first</a><a href='#m'>late</a><main>x</main><div><img alt='A red barn'></div><div><script>1</script></div></body>", "landmarks/content-outside@2 landmarks/content-outside@4 landmarks/content-outside@8"),
    ("<html lang=en><body><div><main>x</main>beside</div><section>unnamed <h2>deep</h2></section></body>", "landmarks/content-outside@2 landmarks/content-outside@6"),
    ("<main><h1>t</h1><a href=x><img src=y alt='A barn'></a></main>", ""), ("<main><h1>t</h1><a href=x>same</a><a href=x>same</a></main>", ""), ("<main><h1>t</h1><button aria-label='Send now'>Send</button></main>", ""), ("<main><h1>t</h1><label for=q>Name *</label><input id=q required></main>", ""),
    ("<main><h1>t</h1><ul role=listbox aria-label=x><li role=option tabindex=0>y</li></ul></main>", ""), ("<main><h1>t</h1><p role=alert aria-live=assertive>x</p></main>", ""), ("<main><h1>t</h1><details><summary>More</summary>x</details></main>", ""), ("<main><h1>t</h1><a href=x target=_blank>Report (opens in new window)</a></main>", ""),
    ("<main><h1>t</h1><div role=dialog aria-modal=true aria-label=x><button>Close</button></div></main>", ""), ("<main><h1>t</h1><div role=img aria-label=x aria-hidden=false></div></main>", ""), ("<main><h1>t</h1><section><header>a</header></section><article><header>b</header></article></main>", ""), ("<nav aria-label=one>x</nav><nav aria-label=two>y</nav>", ""),
]
#: Datatype: values that are of it, and values that aren't.
VALUES = {
    "ID": (["a", "1-x", "ü"], ["", "a b", "a\t"]), "IDREF": (["x"], ["", " "]), "IDREFS": (["a b", " x "], ["", "  "]), "non-empty-string": ([" ", "x"], [""]), "string": (["", "x"], []), "string-without-line-breaks": (["", "a b"], ["a\nb"]),
    "zero": (["0"], ["00", "", "-0"]), "integer": (["-", "12", "-3"], ["", "+1", "1.0"]), "integer-non-negative": (["0", "007"], ["-1", "", "+1"]), "integer-positive": (["1", "001"], ["0", "00", "-1"]),
    "float": (["-1.5", ".5", "1e5", "2E-3"], ["+1", "1.", "", "e5"]), "float-non-negative": (["0", "1.5", "-0", "-0.0e5"], ["-1", "1."]), "float-positive": (["0.01", "5"], ["0", "0.0", "0e10", "-1"]),
    "hash-name": (["#a", "# "], ["#", "a", ""]), "custom-element-name": (["a-b", "my-element-1"], ["ab", "A-b", "-a", "font-face", "a-B"]), "autocomplete-any": (["name", "shipping home tel", "section-a billing street-address", "webauthn", "email webauthn", "NAME"], ["", "home", "name tel", "webauthn name", "tel home", "foo"]),
    "browsing-context": (["x", "top"], ["", "_top"]), "browsing-context-or-keyword": (["x", "_BLANK", "_self"], ["", "_x"]), "keylabellist": (["a b", "é", ""], ["ab", "a a"]),
    "language": (["en", "de-AT", "zh-Hant-TW", "x-klingon", "i-lux", "de-1996", "en-u-co-phonebk"], ["e", "abcd", "en-", "mo", "zzz", "ja-Jpan", "en--us"]), "rel-value": (["icon", "stylesheet icon", "foo", "abc"], ["icon icon", "stylesheat", "canonica"]),
    "sandbox-allow-list": (["", "allow-forms Allow-Scripts"], ["allow-x", "allow-forms allow-forms", "allow-scripts allow-same-origin"]), "script-type": (["text/javascript", "module/x", "text/plain; a=b"], ["module", "text/javascript; charset=utf-8", "text/"]),
    "microdata-property": (["name", "https://a/b"], ["a.b", ":x"]), "simple-color": (["#00ffAA"], ["#fff", "red", "#00ffgg"]), "date": (["2024-02-29", "1999-12-31"], ["2023-02-29", "0999-01-01", "2024-13-01", "2024-1-1", "3000-01-01"]),
    "datetime-local": (["2024-01-01T10:30", "2024-01-01 10:30:59.123"], ["2024-01-01T24:00", "2024-01-01", "2024-01-01T10:30:00.1234"]), "datetime-tz": (["2024-01-01T10:30Z", "2024-01-01T10:30+14:00", "2024-01-01T10:30-0330"], ["2024-01-01T10:30", "2024-01-01T10:30+14:30", "2024-01-01T10:30-00:00"]),
    "month": (["2024-12"], ["2024-13", "024-01", "2024"]), "time": (["23:59", "00:00:00.5"], ["24:00", "1:00", "10:00.5"]), "time-datetime": (["2024-02-29", "12-25", "P2DT3H", "4h 18m 3s", "Z", "2024", "2026-W53", " 10:30 "], ["02-30", "P", "PT", "x", "2025-W53"]), "week": (["2024-W52", "2026-W53", "2020-W53"], ["2025-W53", "2024-W00", "2024-W54", "2024W01"]),
    "iri": (["https://a.b/c?d#e", "mailto:x"], ["/a", "a b:c", "http://a b", ""]), "iri-ref": (["/a", "#x", "a/b?c", "https://a"], ["", "a b", "http:/a", "%zz"]), "iri-ref-http-or-https": (["/a", "https://a"], ["mailto:x", "a b"]),
    "email-address": (["x", ""], []), "email-address-list": (["x"], []), "color": (["red", ""], []), "mime-type": (["text/html", "text/html; charset=utf-8", 'a/b;c="d"'], ["text", " text/html", "text/html;", "a/b; c"]), "mime-type-list": (["image/*,.png", "*/*", "a/b , c/d"], ["", "image", "a/b,"]),
    "charset": (["utf-8", "UTF-8", "windows-1252"], ["latin1", "utf8", "x", ""]), "meta-charset": (["text/html; charset=utf-8", "TEXT/HTML;charset='utf-8'"], ["text/html", "text/html; charset=latin1", "charset=utf-8"]), "integrity-metadata": (["sha256-abc=", "sha384-a sha512-b?x", ""], ["md5-abc", "sha256-", "sha256-a!b"]),
    "refresh": (["5", "5; url=/x", "0;  URL=a"], ["", "x", "5;url=x", "5; url='x'", "5; url="]), "circle": (["1,2,3", "-1,-2,0"], ["1,2", "1,2,-3", "1, 2,3"]), "polyline": (["1,2,3,4,5,6"], ["1,2,3,4", "1,2,3,4,5,6,7", "a,2,3,4,5,6"]), "rectangle": (["1,2,3,4"], ["3,2,1,4", "1,2,3", "1,4,3,2"]),
    "source-size-list": (["100vw", "(min-width: 500px) 50vw, 100vw", "auto", "(min-width: 500px) 50vw"], ["", "50", "50vw, 100vw", ","]), "image-candidate-strings": (["a", "a 2x, b 3x", "a 100w, b 200w"], ["", "a 0w", "a 2x, b 2x", "a 1w, b 2x", "a 1W"]),
    "content-security-policy": (["default-src 'self'", "script-src 'none'; img-src https: data:", ""], ["foo-src 'self'", "default-src 'self'; default-src 'self'", "default-src 'bogus'", "upgrade-insecure-requests x"]), "media-query": (["screen", "(min-width: 500px)", "not print and (color)", "screen, print", "only all and (orientation: landscape)"], ["tv", "(bogus: 1)", "screen and", "(min-width"]),
    "xml-name": (["a", "_x:y-1", "é"], ["", "1a", "a b"]), "svg-pathdata": (["M0 0L1 1z", "", "m1,2 3,4 a1 1 0 0 1 5 5"], ["L1 1", "M0", "M0 0 L1", "x"]),
}
