"""Pages whose content shows in the scores of tag paths alone, names that tell nothing, and attributes as browsers read them."""

import numpy as np
import pytest

from framequarry.llm import tagpaths

SECTION = "<p>Fourth of them, a long paragraph with words, marks and more of it; so it goes.</p><p>Fifth of them, a long paragraph with words, marks and more of it; so it goes.</p>"


def article(extra):
    body = "".join(f"<p>{w} A long paragraph of it, with words and marks; it goes on, and on, until the end of it.</p>" for w in ("One.", "Two.", "Three."))
    return f"<article><h1>T</h1>{body}{extra}</article>"


@pytest.mark.parametrize("name", ["legal-background", "share-price-analysis", "cookie-recipe", "search-results-discussed", "banner-history", "form-follows-function", "comment-on-results", "related-work", "notice-of-motion", "register-analysis"])
def test_sections_whose_names_are_of_their_subject_stay(name):
    got = tagpaths.extract_main_text(article(f"<section id='{name}'>{SECTION}</section>"))
    assert got.count("\n") == 5 and "Fourth" in got and "Fifth" in got


def test_a_name_alone_removes_no_paragraph():
    assert "Fourth" in tagpaths.extract_main_text(article(f"<p class='notice'>{SECTION[3:81]}</p>"))
    assert "Follow us" not in tagpaths.extract_main_text(article("<div>Follow us on Fb, Tw, Ig</div>"))


def test_a_quote_begins_a_value_only_after_an_equals_sign():
    one, two = "One, with words and marks; it goes on, so.", "Two, with words and marks; it goes on, so."
    assert tagpaths.extract_main_text(f"<p title=it's>{one}<p title=it's>{two}") == f"{one}\n{two}"
    assert tagpaths.extract_main_text(f'<p title = "a > b" lang=\'x>y\'>{one}<p data-x="unclosed>{two}') == f"{one}\n{two}"
    assert tagpaths.extract_main_text(f"<script data-a=it's>var x = '<p>no</p>'</script><p>{one}") == one


def test_names_beside_an_article_do_not_outweigh_it():
    assert tagpaths.extract_main_text("<div class=ad>An advert, longer than all the rest of it. Buy.</div><article><h1>Short.</h1><p>Short, too.</article>") == "Short.\nShort, too."


def pages():
    """Articles in plain elements, and around them short blocks that no name gives away."""
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in ("re", "to", "an", "mi", "lo") for b in ("den", "sta", "ver", "lin")]
    say = lambda n: " ".join(rng.choice(words, n))
    for _ in range(60):
        body = [f"{say(12)}, {say(9)}; {say(8)}. {say(rng.integers(10, 60))}, {say(6)}." for _ in range(rng.integers(4, 9))]
        before = "".join(f"<div>{say(3)}</div>" for _ in range(rng.integers(1, 4)))
        after = "".join(f"<div><span>{say(2)}</span> {say(1)}</div>" for _ in range(rng.integers(1, 4)))
        inner = "".join(f"<p>{x}</p>" for x in body)
        yield f"<body><div>{before}<h1>{say(4)}</h1>{inner}{after}</div></body>", body


def test_scores_select(monkeypatch):
    right = [tagpaths.extract_main_text(html).split("\n")[1:] == body for html, body in pages()]
    assert all(right)
    rng = np.random.default_rng(1)
    for scores in (lambda p, size, marks, of: (size > 0) * 1.0, lambda p, size, marks, of: (size > 0) * rng.random(len(size))):
        monkeypatch.setattr(tagpaths, "path_scores", scores)
        assert sum(tagpaths.extract_main_text(html).split("\n")[1:] == body for html, body in pages()) < 6
    monkeypatch.undo()


def test_selection_matches_brute_force():
    """Nothing named and no headings: the blocks at the threshold, and short ones between them."""
    for html, _ in pages():
        p = tagpaths.Page(html.replace("h1", "div"))
        of = np.array([e for e, _, _ in p.nodes])
        size = np.array([len(s.strip()) for _, _, s in p.nodes])
        marks = np.array([len(tagpaths._PUNCT.findall(s)) for _, _, s in p.nodes])
        fused = tagpaths.path_scores(p, size, marks, of)
        least = tagpaths.SHARE * (fused * size).sum() / size.sum()
        texts, chosen, weight = {}, set(), {}
        for (_, b, s), f, n in zip(p.nodes, fused, size, strict=True):
            texts[b] = texts.get(b, "") + s
            weight[b] = weight.get(b, 0) + n
            if f >= least and n:
                chosen.add(b)
        order = sorted(texts)
        keep = set(chosen)
        for i, b in enumerate(order):
            left = [x for x in order[:i] if x in chosen]
            rest = [x for x in order[i:] if x in chosen]
            if b not in chosen and left and rest:
                run = [x for x in order if left[-1] < x < rest[0]]
                if sum(weight[x] for x in run) <= weight[left[-1]] + weight[rest[0]]:
                    keep.add(b)
        want = "\n".join(" ".join(texts[b].split()) for b in order if b in keep and texts[b].strip())
        assert tagpaths.extract_main_text(html.replace("h1", "div")) == want
