"""Training of the block labeller: ``python -m matchloom.llm.htmltrain`` writes html_lstm.npz.

Pages are made from a random grammar of ``LAYOUTS`` that knows which blocks are main text: elements
and names that tell what they hold, names alone, neither, and tables. Words are random letters
(so that no language is learned), apart from the words that menus, notices, forms, comments and
footers tend to use.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from .htmlmain import HIDDEN, SIZE, Labeller, Leaf, _sigmoid, leaves, vectors

PAGES, EPOCHS, BATCH, SEED = 12_000, 8, 48, 5
LAYOUTS = ("told", "plain", "table")
MARK = "\x02"  # starts each block of main text in a made page

MENU = "home about contact news products services login register search help faq blog shop archive".split()
NOTICE = "cookies accept privacy policy subscribe newsletter sign up agree terms consent advert sponsored".split()
TALK = "reply comment says posted by anonymous share like report wrote ago".split()
FOOT = "copyright rights reserved terms imprint contact sitemap powered".split()
CONTENT = "content main-content post entry article story article-body entry-content post-body text body-copy".split()
SIDE = "sidebar widget related aside recommended popular tags recent rail".split()
AD = "ad ads advert banner promo sponsor advertisement".split()
TALKS = "comments comment-list discussion replies respond disqus".split()
SCRIPTS = "please enable javascript browser does not support video audio view this page your".split()
WARN = "cookie-notice notice banner alert consent gdpr newsletter popup".split()


class Maker:
    """Makes pages; blocks of main text start with MARK."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        letters = "etaoinshrdlucmfwypvbgkqjxzäöüéèñßó"
        w = "".join(r.choice(letters[: r.choice((8, 16, 34))]) for _ in range(r.randint(1, 11)))
        return w + r.choice(("", "", "", "", "", ",", "&amp;", "%%%", "$$$"))

    def words(self, low: int, high: int, extra: list[str] | None = None) -> str:
        r = self.r
        return " ".join(r.choice(extra) if extra and r.random() < 0.4 else self.word() for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 3, high: int = 25) -> str:
        return self.words(low, high).capitalize() + self.r.choice(("." * 8 + "!?:"))

    def name(self, names: list[str]) -> str:
        r = self.r
        n = r.choice(names)
        return r.choice((f' class="{n}"', f' id="{n}"', f' class="{self.word()[:5]} {n}"', f" class='{n}-{r.randint(1, 9)}'"))

    def close(self, tag: str) -> str:
        return "" if self.r.random() < 0.1 else f"</{tag}>"

    def links(self, low: int, high: int, extra: list[str]) -> str:
        items = [f'<li><a href="/{self.word()}">{self.words(1, 3, extra)}</a></li>' for _ in range(self.r.randint(low, high))]
        return "<ul>" + "".join(items) + "</ul>" if self.r.random() < 0.8 else "".join(f'<a href="#">{self.words(1, 3, extra)}</a> ' for _ in range(self.r.randint(low, high)))

    def odd(self) -> str:
        """Text that looks little like prose: repeats, tables in lines, shouting, licences."""
        r, x = self.r, self.r.random()
        if x < 0.4:
            text = " ".join(" ".join([self.word()] * r.randint(2, 40)) for _ in range(r.choice((1, 1, 2, 6))))
            return text if r.random() < 0.5 else text.capitalize() + "."
        if x < 0.55:
            return " | ".join(self.word() for _ in range(r.randint(2, 40)))
        if x < 0.7:
            return self.words(2, 40).upper() + r.choice(("!!", "", "."))
        if x < 0.85:
            return self.words(2, 12, FOOT + ["licensed", "license", "under", "the", "version", "work", "public"]) + r.choice((".", " 2.0.", ""))
        return self.words(1, 12, MENU + NOTICE + TALK) + r.choice((".", ""))

    def paragraph(self) -> str:
        r = self.r
        n = r.choice((1, 1, 1, 2, 4, 8))
        text = " ".join(self.sentence(1, 30) for _ in range(n)) if r.random() < 0.75 else self.odd()
        if r.random() < 0.2:
            text += f' <a href="/x">{self.words(1, 4)}</a> ' + self.sentence(1, 9)
        if r.random() < 0.05:
            text += r.choice((" <math><mi>x</mi><mo>=</mo><mrow><mn>2</mn></mrow></math> ", ' <svg><path d="M0"/></svg> ', "<noscript><img src=x></noscript> ")) + self.sentence(1, 9)
        if r.random() < 0.15:
            text = f"<b>{text}" + r.choice(("</b>", "", "<br>", "</b><br>"))
        return f"<p>{MARK}{text}" + self.close("p")

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            h = r.choice(("h1", "h1", "h2"))
            title = f"<{h}>{MARK}{self.words(2, 14)}</{h}>"
            if r.random() < 0.3:
                deck = f"<p>{MARK}{self.sentence()}</p>" if r.random() < 0.3 else ""
                title = f"<header{r.choice(('', self.name(['entry-header', 'article-header', 'post-header', 'header'])))}>{title}{deck}</header>"
            out.append(title)
        # a long one now and then, and paragraphs alike, so that the states stay put in them
        n = r.choice((0, 1, 1, 2, 3, 5, 8, 14)) if r.random() > 0.03 else r.randint(40, 250)
        again = self.paragraph() if n > 20 and r.random() < 0.4 else ""
        for _ in range(n):
            x = r.random()
            if again and x < 0.9:
                out.append(again)
            elif x < 0.10:
                out.append(self.rarer())
            elif x < 0.72:
                out.append(self.paragraph())
            elif x < 0.8:
                out.append(f"<h{(k := r.randint(2, 4))}>{MARK}{self.words(1, 9)}</h{k}>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.sentence(2, 15)}</li>" for _ in range(r.randint(1, 6))) + "</ul>")
            elif x < 0.89:
                out.append(f"<blockquote>{MARK}{self.sentence()}</blockquote>")
            elif x < 0.91:
                out.append(f"<pre>{MARK}{self.words(3, 20)}</pre>")
            elif x < 0.94:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            else:
                out.append(self.junk())
        return "".join(out) or self.paragraph()

    def rarer(self) -> str:
        """Blocks of an article that few articles have, main text or not."""
        r, x = self.r, self.r.random()
        if x < 0.25:
            return f"<noscript>{self.paragraph()}</p></noscript>"
        if x < 0.4:
            return f"<object{r.choice(('', ' data=x'))}>{self.paragraph()}</p></object>"
        if x < 0.6:
            return f"<figure><img src=x><figcaption>{MARK}{self.sentence(2, 12)}</figcaption></figure>"
        if x < 0.7:
            return "<dl>" + "".join(f"<dt>{MARK}{self.words(1, 4)}<dd>{MARK}{self.sentence()}" for _ in range(r.randint(1, 4))) + "</dl>"
        if x < 0.85:
            return f"<button>{self.words(1, 3, TALK + NOTICE)}</button>"
        if x < 0.93:
            return f"<video>{self.words(3, 9, SCRIPTS)}</video>"
        return f"<footer>{self.words(1, 4, TALK + MENU)}</footer>"

    def junk(self) -> str:
        r, x = self.r, self.r.random()
        if r.random() < 0.06:
            text = self.words(4, 12, SCRIPTS) + "."
            return f"<noscript>{r.choice((text, f'<p>{text}</p>', f'<div>{text}</div>'))}</noscript>"
        if x < 0.3:
            return f"<div{self.name(AD)}>{self.sentence(2, 20) if r.random() < 0.8 else self.odd()}</div>"
        if x < 0.5:
            t = r.choice(("aside", "div"))
            return f"<{t}{self.name(SIDE)}><h3>{self.words(1, 4)}</h3>{self.links(1, 6, MENU)}</{t}>"
        if x < 0.65:
            return f"<form{self.name(WARN)}><label>{self.words(1, 4, NOTICE)}</label><input><p>{self.words(3, 10, NOTICE)}</p></form>"
        if x < 0.85:
            return f"<div{self.name(WARN)}><p>{self.words(4, 25, NOTICE)}.</p></div>"
        return f"<aside{r.choice(('', self.name(SIDE)))}><p>{self.sentence()}</p><p>{self.sentence()}</p></aside>"

    def comments(self) -> str:
        r = self.r
        t = r.choice(("div", "section", "ol"))
        one = "li" if t == "ol" else r.choice(("div", "article"))
        inner = "".join(
            f'<{one} class="comment"><p>{self.words(1, 3, TALK)}</p><p>{" ".join(self.sentence() for _ in range(r.randint(1, 4)))}</p></{one}>' for _ in range(r.randint(1, 8))
        )
        return f"<{t}{self.name(TALKS)}><h3>{self.words(1, 3, TALK)}</h3>{inner}</{t}>"

    def page(self, layout: str | None = None) -> str:
        layout = layout or self.r.choice(("told", "told", *LAYOUTS))
        body = {"told": self.told, "plain": self.plain, "table": self.table}[layout]()
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{margin:0}}</style></head><body>{body}" + self.r.choice(("", "</body></html>"))

    def box(self, inner: str) -> str:
        """A division whose name tells nothing."""
        name = "".join(self.r.choice("bcdfghklmnprstvwz") for _ in range(self.r.randint(2, 7)))
        return f"<div{self.r.choice(('', f' class={name}', f' id={name}'))}>{inner}</div>"

    def talk(self) -> str:
        r = self.r
        says = "".join(self.box(f"<p>{self.words(1, 4, TALK)}</p><p>{self.sentence()}</p><p>{self.words(1, 2, TALK)}</p>") for _ in range(r.randint(1, 5)))
        return self.box(f"<h3>{r.choice(('Comments', 'Leave a reply', 'Discussion', '3 comments', 'Reader comments'))}</h3>{says}")

    def plain(self) -> str:
        r, out = self.r, []
        if r.random() < 0.6:
            out.append(self.box(r.choice((self.words(1, 4), f"<p>{self.words(1, 4)}</p>"))))
        out.append(self.box(self.links(2, 10, MENU)))
        if r.random() < 0.3:
            out.append(self.box(f"<p>{self.words(4, 20, NOTICE)}.</p>"))
        # the labeller cannot know a text of a line or two that nothing tells from the rest
        out.append(self.box(f"<h1>{MARK}{self.words(2, 12)}</h1>" + "".join(self.paragraph() + "</p>" for _ in range(r.randint(2, 6))) + self.article()))
        if r.random() < 0.4:
            out.append(self.talk())
        if r.random() < 0.5:
            out.append(self.box(f"<h3>{self.words(1, 3, SIDE + MENU)}</h3>{self.links(2, 8, MENU)}"))
        out.append(self.box(f"&copy; {self.words(1, 12, FOOT)}"))
        return "".join(out)

    def table(self) -> str:
        r = self.r
        head = f"<tr><td>{self.words(1, 4)}</td></tr>" if r.random() < 0.6 else ""
        side = f"<td>{self.links(3, 10, MENU)}</td>"
        main = f"<td><h1>{MARK}{self.words(2, 12)}</h1>" + "".join(self.paragraph() + "</p>" for _ in range(r.randint(2, 6))) + "</td>"
        row = side + main if r.random() < 0.7 else main + side
        return f"<table>{head}<tr>{row}</tr><tr><td>&copy; {self.words(1, 12, FOOT)}</td></tr></table>"

    def told(self) -> str:
        r, out = self.r, []
        if r.random() < 0.5:
            out.append(f"<header{r.choice(('', self.name(['header', 'masthead', 'top'])))}><{(h := r.choice(('h1', 'p', 'div')))}>{self.words(1, 6)}</{h}></header>")
        if r.random() < 0.85:
            t = r.choice(("nav", "nav", "div"))
            out.append(f"<{t}{self.name(['menu', 'nav', 'navbar', 'navigation']) if t == 'div' or r.random() < 0.4 else ''}>{self.links(2, 12, MENU)}</{t}>")
        if r.random() < 0.2:
            out.append(f"<div{self.name(['breadcrumb', 'breadcrumbs'])}>{self.links(1, 4, MENU)}</div>")
        out += [self.junk() for _ in range(r.choice((0, 1, 1, 2)))]
        t, extra = r.choice((("article", ""), ("article", ""), ("article", self.name(CONTENT)), ("main", ""), ("div", self.name(CONTENT)), ("section", self.name(CONTENT))))
        body = f"<{t}{extra}>{self.article()}{self.close(t)}"
        if r.random() < 0.25:
            body = f"<main>{body}</main>" if t != "main" else f"<div{self.name(['wrapper', 'page', 'container'])}>{body}</div>"
        out.append(body)
        if r.random() < 0.35:
            out.append(self.comments())
        out += [self.junk() for _ in range(r.choice((0, 0, 1, 2)))]
        if r.random() < 0.85:
            t = r.choice(("footer", "footer", "div"))
            out.append(f"<{t}{self.name(['footer', 'bottom', 'colophon']) if t == 'div' or r.random() < 0.3 else ''}>{r.choice(('&copy; ', '', '<p>'))}{self.words(1, 15, FOOT)} &middot; {self.sentence() if r.random() < 0.8 else self.odd()}</{t}>")
        return "".join(out)


def labelled(html: str) -> tuple[list[Leaf], np.ndarray]:
    """The leaves of a made page, without MARK, and which are main text."""
    page = leaves(html)
    labels = np.array([MARK in leaf.text for leaf in page], np.float32)
    for leaf in page:
        leaf.text = leaf.text.replace(MARK, "").strip() or "x"
    return page, labels


def made(n: int, seed: int, layout: str | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and labels of the leaves of n pages."""
    maker, out = Maker(seed), []
    while len(out) < n:
        page, labels = labelled(maker.page(layout))
        if page:
            out.append((vectors(page), labels))
    return out


def gradient(model: Labeller, batch: list[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of a batch and its gradient in w and v, by back-propagation through time."""
    steps, n, h = max(len(y) for _, y in batch), len(batch), HIDDEN
    x, y, mask = np.zeros((steps, n, SIZE), np.float32), np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
    for k, (v, labels) in enumerate(batch):
        x[: len(v), k], y[: len(v), k], mask[: len(v), k] = v, labels, 1
    sizes = [len(t) for _, t in batch]

    def turned(a: np.ndarray) -> np.ndarray:
        out = np.zeros_like(a)
        for k, s in enumerate(sizes):
            out[:s, k] = a[:s, k][::-1]
        return out

    tapes, hidden = [], []
    for d in range(2):
        w, xs = model.w[d], x if d == 0 else turned(x)
        hs, cs, gates = np.zeros((steps + 1, n, h), np.float32), np.zeros((steps + 1, n, h), np.float32), np.empty((steps, n, 4 * h), np.float32)
        drive = xs @ w[:SIZE] + w[-1]
        for t in range(steps):
            a = drive[t] + hs[t] @ w[SIZE:-1]
            g = np.concatenate([_sigmoid(a[:, : 3 * h]), np.tanh(a[:, 3 * h :])], axis=1)
            cs[t + 1] = g[:, h : 2 * h] * cs[t] + g[:, :h] * g[:, 3 * h :]
            hs[t + 1] = g[:, 2 * h : 3 * h] * np.tanh(cs[t + 1])
            gates[t] = g
        tapes.append((xs, hs, cs, gates))
        hidden.append(hs[1:] if d == 0 else turned(hs[1:]))
    both = np.concatenate(hidden, axis=2)
    p = _sigmoid(both @ model.v[:-1] + model.v[-1])
    total = mask.sum()
    loss = -(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
    e = mask * (p - y) / total
    dv = np.concatenate([np.einsum("tn,tnk->k", e, both), [e.sum()]])
    dw = np.zeros_like(model.w)
    for d in range(2):
        xs, hs, cs, gates = tapes[d]
        dh = e[:, :, None] * model.v[d * h : (d + 1) * h]
        dh = dh if d == 0 else turned(dh)
        w, da = model.w[d], np.empty_like(gates)
        later, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            g, th = gates[t], np.tanh(cs[t + 1])
            i, f, o, u = g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h], g[:, 3 * h :]
            now = dh[t] + later
            dc = dc + now * o * (1 - th * th)
            da[t] = np.concatenate([dc * u * i * (1 - i), dc * cs[t] * f * (1 - f), now * th * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dc = dc * f
            later = da[t] @ w[SIZE:-1].T
        flat = da.reshape(-1, 4 * h)
        dw[d, :SIZE] = xs.reshape(-1, SIZE).T @ flat
        dw[d, SIZE:-1] = hs[:-1].reshape(-1, h).T @ flat
        dw[d, -1] = flat.sum(axis=0)
    return float(loss), dw, dv


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((2, SIZE + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32) * 0.08
    w[:, -1, HIDDEN : 2 * HIDDEN] = 1.0
    model = Labeller(w, rng.standard_normal(2 * HIDDEN + 1) * 0.1)
    data = sorted(made(pages, seed), key=lambda d: len(d[1]))
    batches = [data[i : i + BATCH] for i in range(0, len(data), BATCH)]
    moments = [np.zeros_like(model.w), np.zeros_like(model.w), np.zeros_like(model.v), np.zeros_like(model.v)]
    step = 0
    for epoch in range(epochs):
        total = 0.0
        for k in rng.permutation(len(batches)):
            loss, dw, dv = gradient(model, batches[k])
            total += loss
            step += 1
            rate = 0.004 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for value, g, m, s in ((model.w, dw, *moments[:2]), (model.v, dv, *moments[2:])):
                g = np.clip(g, -1, 1)
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                value -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {total / len(batches):.4f}", flush=True)
    return model


def accuracy(model: Labeller, pages: int, seed: int) -> float:
    data = made(pages, seed)
    right = [((p >= 0.5) == (y > 0.5)).mean() for (v, y) in data for p in model.scores([v])]
    return float(np.mean(right))


def precision_and_recall(model: Labeller, layout: str, pages: int, seed: int) -> tuple[float, float]:
    """Of the characters taken as main text on a layout's pages, and of those that are."""
    maker, right, taken, wanted = Maker(seed), 0.0, 0.0, 0.0
    for _ in range(pages):
        page, labels = labelled(maker.page(layout))
        size = np.array([len(leaf.text) for leaf in page])
        (score,) = model.scores([vectors(page)])
        right += size[(score >= 0.5) & (labels > 0.5)].sum()
        taken += size[score >= 0.5].sum()
        wanted += size[labels > 0.5].sum()
    return right / max(taken, 1), right / max(wanted, 1)


if __name__ == "__main__":
    trained = train()
    for layout in LAYOUTS:
        print(layout, "precision and recall: {:.4f} {:.4f}".format(*precision_and_recall(trained, layout, 300, SEED + 1)))
    np.savez_compressed(Path(__file__).with_name("html_lstm.npz"), w=trained.w.astype(np.float16), v=trained.v.astype(np.float16))
