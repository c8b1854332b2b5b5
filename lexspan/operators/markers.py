"""The markers of the marked-up format and what each one is; custom markers by category.

Names and categories are the published standard's (fixed values). A family with levels is written with its highest one:
`mt4` stands for mt, mt1, .. mt4.
"""

from __future__ import annotations

import re

# Fixed values.
_BY_KIND = {
    "book": "id",
    "head": "usfm ide h3 rem sts toc3 toca3",
    "title": "mt4 mte2 imt4 imte2",
    "intro": "ib ie iex ili2 im imi imq io4 iot ip ipc ipi ipq ipr iq3 is2",
    "chapter": "c",
    "verse": "v",
    "paragraph": "cls lit m mi3 nb p pc ph3 pi3 pm pmc pmo pmr po pr lf lh li4 lim4 b q4 qa qc qd qm3 qr",
    "heading": "cd cl cp d mr ms3 r s4 sd4 sp sr",
    "row": "tr",
    "cell": "tc12 tcc12 tcr12 th12 thc12 thr12",
    "note": "f fe ef x ex",
    "notechar": "fr ft fk fl fp fq fqa fv fw fdc xo xk xop xot xnt xq xt xta xdc",
    "char": "ca va vp bd bdit it no sc sup ior iqt lik litl liv9 qac qs add addpn bk dc em jmp k nd ord pn png pro qt5 rb ref rq sig sls ta tl w wa wg wh wj wl fm fig cat",
    "break": "pb",
    "milestone": "list table ts vid",
    "sidebar": "esb esbe",
    "periph": "periph",
}
#: Markers that have no use in books of version 3.0 or later, and what took their place where something did (fixed values).
DEPRECATED = {"addpn": None, "fdc": None, "ph": "li", "pro": "rb", "xdc": None}
#: Categories of custom markers, and the kind of marker that each one makes; '' of those that make none (fixed values).
CATEGORIES = {
    "header": "head", "title": "title", "introduction": "intro", "sectionpara": "heading", "versepara": "paragraph", "list": "paragraph", "otherpara": "paragraph",
    "crossreference": "note", "footnote": "note", "char": "char", "introchar": "char", "listchar": "char", "footnotechar": "notechar", "crossreferencechar": "notechar",
    "milestone": "milestone", "attribute": "", "cell": "cell", "standalone": "milestone", "internal": "",
}


def _spelled() -> tuple[dict[str, str], dict[str, str]]:
    """marker -> kind, and marker -> family of the families with levels."""
    kinds, families = {}, {}
    for kind, names in _BY_KIND.items():
        for name in names.split():
            stem, top = re.match(r"([a-z]+)(\d*)\Z", name).groups()
            spellings = [stem, *(f"{stem}{k}" for k in range(1, int(top or 0) + 1))]
            kinds |= dict.fromkeys(spellings, kind)
            families |= dict.fromkeys(spellings if top else [], stem)
    return kinds, families


MARKERS, FAMILIES = _spelled()


def of_kind(*kinds: str) -> list[str]:
    return [m for m, k in MARKERS.items() if k in kinds]


def definitions(text: str) -> tuple[list[dict], list[tuple]]:
    """The custom markers of a definitions file (name, category, description, attributes), and what could not be kept (line,
    name, why): one field a line, `\\marker` opens an entry, every flaw costs only itself or its entry."""
    entries, flaws, entry = [], [], None
    for number, line in enumerate(text.lstrip("\ufeff").split("\n"), 1):
        found = re.match(r"\s*(?:\\(\S*)\s*(.*?))?\s*\Z", line.rstrip("\r"))
        if not found:
            flaws.append((number, None, "not a field"))
        elif (field := found[1]) is None:
            continue
        elif field == "marker":
            entry = {"line": number, "name": found[2].removeprefix("\\"), "category": None, "description": "", "attributes": []}
            entries.append(entry)
        elif entry is None:
            flaws.append((number, None, "field before the first marker" if field in ("category", "description", "attribute") else "unknown field"))
        elif field == "category":
            if entry["category"] is not None or found[2].lower() not in CATEGORIES:
                flaws.append((number, entry["name"], "unknown category" if entry["category"] is None else "second category"))
            else:
                entry["category"] = found[2].lower()
        elif field == "description":
            entry["description"] = found[2]
        elif field == "attribute":
            entry["attributes"].append(found[2])
        else:
            flaws.append((number, entry["name"], "unknown field"))
    kept, names = [], set()
    for e in entries:
        why = None if re.match(r"z[A-Za-z0-9]*\Z", e["name"]) else "not a custom name"
        why = why or (None if e["category"] else "no category") or ("defined twice" if e["name"] in names else None)
        if why:
            flaws.append((e["line"], e["name"], why))
        else:
            names.add(e["name"])
            kept.append({k: e[k] for k in ("name", "category", "description", "attributes")})
    return kept, sorted(flaws, key=lambda f: f[0])


def with_custom(text: str) -> dict[str, str]:
    """MARKERS and the custom markers of a definitions file, each with the kind that its category makes."""
    return MARKERS | {e["name"]: CATEGORIES[e["category"]] for e in definitions(text)[0] if CATEGORIES[e["category"]]}
