"""Main text of pages: unusual containers, deep nesting, and a brute-force version."""

import html as entities
import random
import time

import pytest

from dnsglass.llm import html_text as h

WORDS = "one two three four five six seven eight nine ten."
LONG = " ".join([WORDS] * 4)
ADVERT = " ".join(["buy this now"] * 40)


@pytest.fixture(scope="module")
def weights():
    return h.Weights({}, {})


def test_container_named_both_ways(weights):
    assert h.extract(f'<body><nav>a b</nav><div class="legal content"><p>{LONG}</p></div></body>', weights) == LONG
    # a small one, one beside content that is named as such, and one that only a compound names
    assert h.extract(f'<body><p>{LONG}</p><div class="legal content"><p>{WORDS}</p></div></body>', weights) == LONG
    assert h.extract(f'<body><article>{WORDS}</article><div class="comments content">{LONG}</div></body>', weights) == WORDS
    assert h.extract(f'<body><div class="related-content">{LONG}</div></body>', weights) == ""


def test_two_articles_with_an_advert_between(weights):
    page = f'<body><article><p>{LONG}</p></article><div class="ad">{ADVERT}</div><article id="b"><p>Second {WORDS}</p></article><footer>x y</footer></body>'
    assert h.extract(page, weights) == f"{LONG} Second {WORDS}"
    # an article inside boilerplate is none of them
    page = f'<body><article><p>{LONG}</p></article><aside>{ADVERT}<article>Teaser</article></aside></body>'
    assert h.extract(page, weights) == LONG


def test_formulas_breaks_and_quotations(weights):
    page = f"<article><p>energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> end</p><p>foo<wbr>bar</p><blockquote class='social'>a quotation</blockquote><p>{LONG}</p></article>"
    assert h.extract(page, weights) == f"energy E=m end foobar a quotation {LONG}"
    assert h.extract(f"<article>{LONG}</article><blockquote class='social'>a quotation</blockquote>", weights) == LONG


@pytest.mark.parametrize("page, text", [
    ("<div>" * 40_000 + f"<p>{LONG}", LONG),
    (f"<section><p>{WORDS}</p></x>" * 40_000, " ".join([WORDS] * 40_000)),
    ("<article>" + "<div class=ad>" * 40_000 + "no", ""),
])
def test_deep_nesting_is_linear(weights, page, text):
    start = time.time()
    assert h.extract(page, weights) == text
    h.labelled_counts(page)
    assert time.time() - start < 20  # minutes if each element looked at all those around it


def _brute_region(scores):
    """All regions; of equal sums the one that ends first, then the shortest."""
    best = max(((sum(scores[a:b]), -b, a, (a, b)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, (0, 0)))
    return best[3] if best[0] > 0 else (0, 0)


def test_region_is_the_best_of_all():
    dice = random.Random(3)
    for _ in range(300):
        scores = [dice.choice((-3, -2, -1, 0, 1, 2)) for _ in range(dice.randint(0, 14))]
        assert h.best_region(scores) == _brute_region(scores)


def _brute_extract(page, weights, trusted=0):
    """The text by the definition: every piece looks at all elements around it."""
    stack, seen, number, paragraph = [], [], 0, False
    for kind, value, marks in h.tokens(page):
        told = []
        for i, (name, own, n) in enumerate(stack):
            odds = [weights.odds[f] for f in (name, *own) if abs(weights.odds.get(f, 0)) >= 1]
            around = [(n, t) for (n, _, _), t in zip(stack[:i], told)]
            clean = not any(t < 0 or n in h.SKIPPED for n, t in around)
            content = any(t > 0 for n, t in around if n not in ("html", "body"))
            if name == "header" and any(n in ("article", "main") for n, _ in around):
                odds = []
            if name in h.QUOTED and content and clean and min(odds, default=0) < 0:
                odds = []
            told.append(0 if not odds else min(odds) if min(odds) < 0 and n != trusted else max(odds))
        skipped = any(n in h.SKIPPED for n, _, _ in stack)
        score = -3.0 if skipped else ([0.5] + [t for t in told if t])[-1]
        if kind != "text" and value not in h.INLINE and value != "br":
            paragraph = kind == "open" and value == "p"
        seen.append((kind, value, list(stack), told, score, paragraph))
        if kind == "open" and value not in h.VOID and (value not in h.LOOSE or marks):
            number += 1
            stack.append((value, marks, number))
        elif kind == "close":
            at = [i for i, e in enumerate(stack) if e[0] == value]
            if at:
                stack = stack[:at[-1]] + (stack[at[-1] + 1:] if value in h.LOOSE else [])

    def lasting(elements):
        return ([0] + [n for name, _, n in elements if name not in h.LOOSE])[-1]

    running, kinds, named = {}, {}, set()
    for i, (kind, value, around, told, score, paragraph) in enumerate(seen):
        if kind != "text" or not value.split() or score <= 0:
            continue
        for j in range(len(around), -1, -1):  # the text runs on up to an element that does not flow
            inner = around[j:]
            if paragraph or all(n in h.FLOW or n in h.LOOSE for n, _, _ in inner):
                if j == 0 or around[j - 1][0] not in h.LOOSE:
                    running.setdefault(around[j - 1][2] if j else 0, []).append(i)
        by = [j for j, t in enumerate(told) if t > 0 and around[j][0] not in ("html", "body")]
        if by:
            outside = around[:by[-1]]
            named |= {0, *(n for _, _, n in outside)}
            if not any(t < 0 or n in h.SKIPPED for (n, _, _), t in zip(outside, told)):
                name, marks, _ = around[by[-1]]
                kinds.setdefault((lasting(outside), name if name in ("article", "main") else (name, marks)), []).append(i)
    if not named and not trusted:  # an element named both ways that holds most words
        words, inside = 0, {}
        for kind, value, around, told, _, _ in seen:
            if kind == "text" and not any(n in h.SKIPPED for n, _, _ in around):
                words += len(value.split())
                both = [n for (name, marks, n), t in zip(around, told) if t < 0 and name not in h.BOILERPLATE and {"content"} & set(marks)]
                if both:
                    inside[both[0]] = inside.get(both[0], 0) + len(value.split())
        for n, count in inside.items():
            if 2 * count > words:
                return _brute_extract(page, weights, n)
    scores = []
    for i, (kind, value, around, told, score, _) in enumerate(seen):
        own = score * len(value.split()) if kind == "text" else weights.tag.get(value, -h.TAG_COST / 2)
        if score <= 0:
            bad = [j for j, t in enumerate(told) if t < 0 or around[j][0] in h.SKIPPED]
            if any(t > 0 for t, e in zip(told, around) if e[0] not in ("html", "body")):
                own = 0.0
            elif around[bad[0]][0] not in h.CELLS | {"html", "body", "head"}:
                element = lasting(around[:bad[0]])
                runs = running.get(element, [])
                if element not in named and runs and runs[0] < i < runs[-1]:
                    own = 0.0
                if any(e == element and at[0] < i < at[-1] for (e, _), at in kinds.items()):
                    own = 0.0
        scores.append(own)
    a, b = _brute_region(scores)
    pieces = [(value if score > 0 else " ") if kind == "text" else "" if value in h.INLINE else " " for kind, value, _, _, score, _ in seen]
    return " ".join(entities.unescape("".join(pieces[a:b])).split())


def test_extract_equals_brute_force():
    dice = random.Random(11)
    weights = h.Weights({}, {("div", False): 30, ("p", True): 40, ("p", False): 3})
    names = ["div", "div", "p", "p", "section", "article", "aside", "nav", "ul", "li", "blockquote", "span", "table", "td", "header", "form", "script", "math"]
    marks = ["", "", "", "", " class='ad'", " class='content'", " id=post-1", " class='comment x'", " class='social'", " class='legal content'", " class=a"]
    full = 0
    for _ in range(700):
        page, left = [], []
        for _ in range(dice.randint(1, 22)):
            what = dice.random()
            if what < 0.42:
                name = dice.choice(names)
                page.append(f"<{name}{dice.choice(marks)}>")
                left.append(name)
            elif what < 0.65 and left:
                page.append(f"</{left.pop(dice.choice((-1, -1, -1, 0)))}>")
            else:
                page.append(" ".join(f"w{dice.randint(0, 99)}" for _ in range(dice.randint(1, 9))) + dice.choice(("", " ", "&amp;")))
        page = "".join(page)
        want = _brute_extract(page, weights)
        assert h.extract(page, weights) == want, page
        full += bool(want)
    assert full > 300
