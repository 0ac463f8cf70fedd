"""Trains the block labeller on pages made up by rules: ``python -m tessera.llm.html_training`` writes block_labeller.npz.

A page is an article in one of several layouts, with menus, headers, footers, sidebars, notices, adverts, forms and reader
comments around and inside it; each block is known to be main text or not, as it is made. Words are random syllables in
several alphabets, so the labels cannot be learnt from the articles' own words.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from tessera.llm.html_blocks import EXTRA, HIDDEN, PATH_BUCKETS, PATH_DIM, WORD_BUCKETS, WORD_DIM, Block, Labeller, blocks, sigmoid

MARK = "⁣"  # put at the end of every main block; taken off before training
SYLLABLES = "an be ti on the of ing ción os en ü ß ver ich eau é ou re qui la ch st ou do ra mi ke sh lu 漢 да не по ka to".split()

#: Usual names of classes, ids and elements in public web pages, and usual words in such blocks.
ADS = "ad ads advert advertisement sponsored promo banner ad-slot ad-container google-ad adsbox promotion sponsor".split()
SIDES = "sidebar side-bar widget related recommended popular trending more-stories rail secondary tags toc".split()
NOTICES = "notice cookie cookie-notice cookie-banner consent alert gdpr paywall popup modal overlay newsletter subscribe toast disclaimer".split()
COMMENTS = "comments comment comment-list reader-comments discussion responses replies disqus comment-body reply".split()
MENUS = "nav menu navbar navigation breadcrumb breadcrumbs pagination pager topbar site-nav main-menu skip toolbar".split()
SOCIAL = "share social sharing social-links share-buttons follow author-bio byline-links".split()
FOOTS = "footer site-footer copyright colophon bottom legal footer-links".split()
HEADS = "header site-header masthead branding logo top-header page-header".split()
MAINS = "content article post entry main story body text article-body post-content entry-content page-content main-content story-body".split()
TALK = {
    "notice": "we use cookies to improve your experience accept all privacy policy subscribe to our newsletter sign up".split(),
    "ad": "advertisement sponsored buy now shop sale offer click here".split(),
    "comment": "reply says said posted ago comment like report thanks great".split(),
    "form": "name email message submit search send your password login".split(),
    "foot": "copyright all rights reserved terms privacy contact about".split(),
    "share": "share tweet facebook print email follow us".split(),
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int, kind: str = "") -> str:
        r = self.r
        out = []
        for _ in range(n):
            if kind and r.random() < 0.4:
                out.append(r.choice(TALK[kind]))
            else:
                out.append("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))))
        if out and r.random() < 0.8:
            out[0] = out[0].capitalize()
            out[-1] += "."
        return " ".join(out)

    def named(self, names: list[str]) -> str:
        r = self.r
        name = r.choice(names)
        if r.random() < 0.15:
            name += f" {r.choice(['clearfix', 'col-4', 'row', 'box', 'wrap', 'inner', 'x1', 'hidden'])}"
        return f' {r.choice(["class", "class", "class", "id"])}="{name}"'

    def para(self, main: bool, n: int, kind: str = "", tags: tuple[str, ...] = ("p",)) -> str:
        r = self.r
        tag = r.choice(tags)
        text = self.words(n, kind)
        if r.random() < 0.2:
            text = f"<b>{text}" + ("</b>" if r.random() < 0.6 else "<br>")
        elif r.random() < 0.15:
            text = f"{text} <a href='/x'>{self.words(2)}</a> {self.words(3)}"
        end = f"</{tag}>" if r.random() < 0.85 or tag != "p" else ""
        return f"<{tag}>{text}{MARK * main}{end}"

    def links(self, names: list[str], tag: str, n: int) -> str:
        r = self.r
        inner = "".join(f"<li><a href='/{i}'>{self.words(r.randint(1, 3))}</a></li>" for i in range(n))
        if r.random() < 0.25:
            inner = "".join(f"<a href='/{i}'>{self.words(1)}</a> " for i in range(n))
        elif r.random() < 0.9:
            inner = f"<ul>{inner}</ul>"
        own = self.named(names) if r.random() < 0.6 or tag == "div" else ""
        return f"<{tag}{own}>{inner}</{tag}>"

    def junk(self) -> str:
        """Something that is not main text."""
        r, k = self.r, self.r.randint(0, 8)
        long = lambda: r.choice([3, 8, 15, 40, 90])
        if k == 0:
            inner = self.words(long(), r.choice(["ad", ""]))
            return f"<div{self.named(ADS)}>{inner if r.random() < 0.6 else self.para(False, long(), 'ad')}</div>"
        if k == 1:
            tag = r.choice(["aside", "aside", "div", "section"])
            own = self.named(SIDES) if tag != "aside" or r.random() < 0.5 else ""
            inner = f"<h3>{self.words(2)}</h3>" * (r.random() < 0.5) + "".join(self.para(False, long()) for _ in range(r.randint(0, 3)))
            return f"<{tag}{own}>{inner}{self.links(SIDES, 'div', 3) if r.random() < 0.4 else ''}{self.words(5)}</{tag}>"
        if k == 2:
            own = self.named(NOTICES) if r.random() < 0.85 else f' role="{r.choice(["alert", "dialog", "banner"])}"'
            return f"<div{own}>{self.para(False, long(), 'notice', ('p', 'span', 'div'))}{'<button>' + self.words(1) + '</button>' if r.random() < 0.4 else ''}</div>"
        if k == 3:
            tag = r.choice(["section", "div", "ol", "ul"])
            item = "li" if tag in ("ol", "ul") else r.choice(["div", "article", "p"])
            inner = "".join(
                f"<{item}{self.named(COMMENTS) if r.random() < 0.4 else ''}>{self.para(False, long(), r.choice(['comment', '']), ('p', 'div', 'span'))}</{item}>" for _ in range(r.randint(1, 5))
            )
            return f"<{tag}{self.named(COMMENTS)}>{'<h2>' + self.words(2, 'comment') + '</h2>' if r.random() < 0.5 and tag not in ('ol', 'ul') else ''}{inner}</{tag}>"
        if k == 4:
            return f"<form{self.named(NOTICES + ['search', 'login']) if r.random() < 0.4 else ''}><label>{self.words(2, 'form')}</label><input name=a>{self.para(False, 4, 'form')}<button>{self.words(1)}</button></form>"
        if k == 5:
            return f"<div{self.named(SOCIAL)}>{self.words(r.randint(1, 6), 'share')}</div>"
        if k == 6:
            return self.links(MENUS, r.choice(["nav", "div", "nav"]), r.randint(2, 8))
        if k == 7:
            return f"<div{self.named(FOOTS)}>{self.para(False, long(), 'foot')}</div>"
        return f"<div{self.named(HEADS)}>{self.para(False, 3, '', ('h2', 'p', 'span', 'div'))}</div>"

    def article(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.9:
            parts.append(f"<h1>{self.words(r.randint(2, 10))}{MARK}</h1>")
            if r.random() < 0.2:
                parts[-1] = f"<header>{parts[-1]}</header>"
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            k = r.random()
            n = r.choice([1, 1, 2, 4, 12, 30, 60, 120])
            if k < 0.72:
                parts.append(self.para(True, n))
            elif k < 0.8:
                parts.append(f"<{(t := r.choice(['h2', 'h3', 'h4']))}>{self.words(r.randint(1, 6))}{MARK}</{t}>")
            elif k < 0.87:
                parts.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.words(r.randint(1, 15))}{MARK}</li>" for _ in range(r.randint(1, 5))) + f"</{t}>")
            elif k < 0.91:
                parts.append(f"<blockquote>{self.para(True, n)}</blockquote>")
            elif k < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(2)}{MARK}</td><td>{self.words(1)}{MARK}</td></tr>" for _ in range(2)) + "</table>")
            elif k < 0.97:
                parts.append(f"<pre>{self.words(n)}{MARK}</pre>")
            else:
                parts.append(f"<div>{self.words(n)}{MARK}</div>")
        for _ in range(r.choice([0, 0, 0, 1, 2])):  # things that do not belong, inside the article
            parts.insert(r.randint(0, len(parts)), "</p>" + self.junk())
        body = "".join(parts)
        k = r.random()
        if k < 0.55:
            tag = f"<article{self.named(MAINS) if r.random() < 0.3 else ''}>"
            body = f"{tag}{body}</article>"
            return f"<main>{body}</main>" if r.random() < 0.25 else body
        if k < 0.7:
            return f"<main{self.named(MAINS) if r.random() < 0.3 else ''}>{body}</main>"
        tag = r.choice(["div", "div", "section"])
        return f"<{tag}{self.named(MAINS)}>{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        top, bottom = [], []
        if r.random() < 0.5:
            top.append(f"<header{self.named(HEADS) if r.random() < 0.4 else ''}>{self.para(False, r.choice([2, 5, 12]), '', ('p', 'h1', 'div', 'span'))}{self.links(MENUS, 'nav', 4) if r.random() < 0.4 else ''}</header>")
        if r.random() < 0.8:
            top.append(self.links(MENUS, "nav", r.randint(2, 8)))
        top += [self.junk() for _ in range(r.choice([0, 1, 1, 2]))]
        bottom += [self.junk() for _ in range(r.choice([0, 0, 1, 2]))]
        if r.random() < 0.85:
            bottom.append(f"<footer{self.named(FOOTS) if r.random() < 0.3 else ''}>{self.words(r.choice([1, 3, 8, 20]), r.choice(['foot', '']))}{self.links(FOOTS, 'div', 3) if r.random() < 0.2 else ''}</footer>")
        inner = "".join(top) + (self.article() if r.random() < 0.97 else "") + "".join(bottom)
        if r.random() < 0.2:
            inner = f'<div class="{r.choice(["wrapper", "container", "page", "site", "layout"])}">{inner}</div>'
        return f"<html><head><title>x</title></head><body>{inner}" + ("</body></html>" if r.random() < 0.9 else "")


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    read = blocks(page)
    y = np.array([b.text.endswith(MARK) or MARK in b.text for b in read], np.float32)
    return [Block(b.node, t, min(b.linked, len(t))) for b in read if (t := b.text.replace(MARK, "").strip() or ".")], y


def weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = PATH_DIM + WORD_DIM + EXTRA
    w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "skip": rng.normal(0, 0.1, size), "bias": np.zeros(1)}
    for side in "fb":
        w |= {f"x_{side}": rng.normal(0, size**-0.5, (size, 4 * HIDDEN)), f"h_{side}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"b_{side}": np.zeros(4 * HIDDEN)}
        w[f"b_{side}"][:HIDDEN] = 1
    return {k: v.astype(np.float32) for k, v in w.items()}


def step(m: Labeller, batch: list[tuple[tuple, np.ndarray]]) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients over some pages, by backpropagation through time."""
    w = m.w
    lengths = np.array([len(y) for _, y in batch])
    path, word = sum((x[0] for x, _ in batch), []), sum((x[1] for x, _ in batch), [])
    x = m.inputs(path, word, np.concatenate([x[2] for x, _ in batch]))
    y = np.concatenate([y for _, y in batch])
    n, steps = len(batch), int(lengths.max())
    mask = np.arange(steps) < lengths[:, None]
    rows, cols = np.nonzero(mask)
    live = mask.astype(np.float32)
    places = {"f": cols, "b": lengths[rows] - 1 - cols}
    saved, states = {}, []
    for side in "fb":
        z_in = np.zeros((n, steps, x.shape[1]), np.float32)
        z_in[rows, places[side]] = x
        h = c = np.zeros((n, HIDDEN), np.float32)
        trace, out = [], np.zeros((n, steps, HIDDEN), np.float32)
        gates = z_in @ w[f"x_{side}"] + w[f"b_{side}"]
        for t in range(steps):
            z = gates[:, t] + h @ w[f"h_{side}"]
            s, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = s[:, :HIDDEN] * c + s[:, HIDDEN : 2 * HIDDEN] * g
            tc = np.tanh(c)
            h = s[:, 2 * HIDDEN :] * tc
            trace.append((before, s, g, tc))
            h, c = h * live[:, t, None], c * live[:, t, None]
            out[:, t] = h
        saved[side] = (z_in, trace)
        states.append(out[rows, places[side]])
    both = np.concatenate(states, 1)
    p = sigmoid(both @ w["out"] + x @ w["skip"] + w["bias"])
    loss = float(-(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)).mean())
    d = (p - y).astype(np.float32) / len(batch)
    grad = {"out": both.T @ d, "skip": x.T @ d, "bias": d.sum(keepdims=True)}
    d_x = np.outer(d, w["skip"])
    for k, side in enumerate("fb"):
        z_in, trace = saved[side]
        d_out = np.zeros((n, steps, HIDDEN), np.float32)
        d_out[rows, places[side]] = np.outer(d, w["out"][k * HIDDEN : (k + 1) * HIDDEN])
        d_gates = np.zeros((n, steps, 4 * HIDDEN), np.float32)
        d_h = d_c = np.zeros((n, HIDDEN), np.float32)
        g_h = np.zeros_like(w[f"h_{side}"])
        for t in range(steps - 1, -1, -1):
            (h0, c0), s, g, tc = trace[t]
            f, i, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            dh = (d_h + d_out[:, t]) * live[:, t, None]
            dc = d_c * live[:, t, None] + dh * o * (1 - tc**2)
            dz = np.concatenate([dc * c0 * f * (1 - f), dc * g * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
            d_gates[:, t] = dz
            g_h += h0.T @ dz
            d_h, d_c = dz @ w[f"h_{side}"].T, dc * f
        flat = d_gates[rows, places[side]]
        grad |= {f"h_{side}": g_h, f"x_{side}": x.T @ flat, f"b_{side}": flat.sum(0)}
        d_x += flat @ w[f"x_{side}"].T
    for name, lists, at, mean in (("path", path, 0, False), ("word", word, PATH_DIM, True)):
        g = np.zeros_like(w[name])
        sizes = np.array([len(v) for v in lists])
        part = d_x[:, at : at + w[name].shape[1]] / (np.maximum(sizes, 1)[:, None] if mean else 1)
        np.add.at(g, np.concatenate(lists), np.repeat(part, sizes, axis=0))
        grad[name] = g
    return loss, grad


def train(pages: int = 6_000, epochs: int = 8, seed: int = 5) -> Labeller:
    rng, make = np.random.default_rng(seed), Maker(seed)
    m = Labeller(weights(rng))
    data = []
    for _ in range(pages):
        read, y = labelled(make.page())
        if read:
            data.append((m.numbers(read), y))
    touched = {k: np.zeros(len(m.w[k]), bool) for k in ("path", "word")}
    for (path, word, _), _y in data:
        touched["path"][np.concatenate(path)] = True
        touched["word"][np.concatenate(word)] = True
    for k, seen in touched.items():
        m.w[k][~seen] = 0  # what was never seen says nothing
    first = {k: np.zeros_like(v) for k, v in m.w.items()}
    second = {k: np.zeros_like(v) for k, v in m.w.items()}
    done = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        total = 0.0
        for at in range(0, len(order), 32):
            loss, grad = step(m, [data[i] for i in order[at : at + 32]])
            total += loss
            done += 1
            rate = 0.004 * (1 - epoch / epochs) + 2e-4
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9)) + (2e-4 * m.w[k] if k == "word" else 0)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g**2 - second[k])
                m.w[k] -= (rate * (first[k] / (1 - 0.9**done)) / (np.sqrt(second[k] / (1 - 0.999**done)) + 1e-8)).astype(np.float32)
        print(f"epoch {epoch}: loss {total / (len(order) / 32):.5f}", flush=True)
    return m


def accuracy(m: Labeller, pages: int = 1_000, seed: int = 77) -> tuple[float, float]:
    """Share of blocks, and of whole pages, that are labelled right on fresh pages."""
    make = Maker(seed)
    right = total = whole = 0
    for _ in range(pages):
        read, y = labelled(make.page())
        ok = (m.scores([read])[0] >= 0.5) == y if read else np.ones(1, bool)
        right, total, whole = right + ok.sum(), total + len(ok), whole + ok.all()
    return right / total, whole / pages


if __name__ == "__main__":
    model = train()
    print("held out:", accuracy(model))
    np.savez_compressed(Path(__file__).with_name("block_labeller.npz"), **{k: v.astype(np.float16) if k in ("path", "word") else v for k, v in model.w.items()})
