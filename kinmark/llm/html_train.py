"""Trains the block labeller on made-up pages: python -m kinmark.llm.html_train.

Pages are put together from parts with known labels (article text against menus, headers, footers, sidebars,
notices, adverts, forms and reader comments) in many layouts, with and without telling names, in invented words.
Truncated backpropagation is not needed: sequences are short enough to run through whole.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from kinmark.llm.html_extract import HIDDEN, INPUTS, Labeller, _sigmoid, blocks_of, describe

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve sch ung keit ein ción ado que eau ment é ü ñ".split()
SHORT = "the of and a to in is la de el der die und le les un une que von für con".split()
CHROME = {
    "menu": (("nav", "ul", "div", "div"), "nav navbar menu main-menu navigation topnav breadcrumbs site-nav tabs", ("links", "links", "linklist")),
    "header": (("header", "div", "div"), "header site-header masthead banner logo top-bar branding page-header", ("short", "links", "line")),
    "footer": (("footer", "div", "div"), "footer site-footer colophon copyright bottom legal page-footer credits", ("line", "links", "short", "para")),
    "sidebar": (("aside", "div", "section"), "sidebar side secondary widget related related-posts recommended popular rail more-stories trending", ("links", "para", "linklist", "teasers")),
    "notice": (("div", "section", "div"), "cookie cookie-notice consent gdpr notice alert newsletter subscribe popup modal paywall banner-message", ("line", "para", "button")),
    "advert": (("div", "aside", "ins"), "ad ads advert advertisement sponsored promo promoted sponsor adbox ad-slot", ("line", "para", "short", "links")),
    "form": (("form", "form", "div"), "form search login signup contact-form search-box subscribe-form", ("fields", "fields")),
    "comments": (("section", "div", "ol"), "comments comment comment-list reader-comments discussion responses replies respond", ("talk", "talk")),
    "share": (("div", "ul"), "share social share-buttons tags post-tags follow pagination pager", ("links", "short")),
}
BODY = (("article", "main", "div", "div", "section"), "content main post entry-content article-body story body-text article post-content text page-content single")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.serial = 0
        self.article: set[str] = set()

    def word(self) -> str:
        r = self.r
        return r.choice(SHORT) if r.random() < 0.3 else "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        out = [self.word() for _ in range(self.r.randint(lo, hi))]
        for k in range(1, len(out) - 1):
            if self.r.random() < 0.08:
                out[k] += self.r.choice([",", ".", ",", ";"])
        out[0] = out[0].capitalize()
        style = self.style
        if style == "loud":
            out = [w.upper() + "!!" for w in out]
        elif style == "junk":
            out = [w + self.r.choice(["%%%", "###", "&amp;&amp;&amp;", "***", "$$$"]) for w in out]
        elif style == "bars":
            out = [w + " |" for w in out]
        elif style == "again":
            out = [out[0]] * len(out)
        elif style == "digits":
            out = [str(self.r.randint(10, 10**9)) if self.r.random() < 0.4 else w for w in out]
        return " ".join(out)

    style = "plain"

    def pick(self) -> str:
        return self.r.choices(["plain", "loud", "junk", "bars", "again", "digits"], [0.7, 0.06, 0.06, 0.08, 0.06, 0.04])[0]

    def mark(self, text: str, keep: bool) -> str:
        """A block's text with a serial number, by which its label is found again; removed before describing."""
        self.serial += 1
        tag = f"\ue000{self.serial}{'y' if keep else 'n'}\ue001"
        return tag + text

    def say(self, lo: int, hi: int, keep: bool, stop: bool = True) -> str:
        return self.mark(self.words(lo, hi) + ("." if stop and self.r.random() < 0.9 else ""), keep)

    def named(self, tags: tuple, names: str) -> tuple[str, str]:
        tag = self.r.choice(tags)
        pick = self.r.choice(names.split())
        roll = self.r.random()
        if tag in ("nav", "header", "footer", "aside", "article", "main", "form") and roll < 0.5:
            return tag, ""
        if roll < 0.75:
            return tag, f' class="{pick}"' if self.r.random() < 0.7 else f' class="{self.noise()} {pick}"'
        if roll < 0.92:
            return tag, f' id="{pick}"'
        return tag, f' class="{self.noise()}"'

    def noise(self) -> str:
        return self.r.choice(["css-" + "".join(self.r.choice("abcdefxyz123") for _ in range(5)), "row", "col", "container", "wrapper", "inner", "clearfix", "box", "block", "section", "mt-4"])

    def fill(self, kind: str, keep: bool = False) -> str:
        r = self.r
        if kind == "links":
            items = [f'<li><a href="/{self.word()}">{self.say(1, 3, keep, False)}</a></li>' for _ in range(r.randint(2, 9))]
            return f"<ul>{''.join(items)}</ul>"
        if kind == "linklist":
            sep = r.choice(["</div><div>", "</p><p>", "<br>"])
            if sep == "<br>":
                return "<div>" + self.mark(sep.join(f"<a href='#'>{self.words(1, 4)}</a>" for _ in range(r.randint(2, 7))), keep) + "</div>"
            return f"<div>{sep.join(f'<a href=#>{self.say(1, 4, keep, False)}</a>' for _ in range(r.randint(2, 7)))}</div>"
        if kind == "short":
            return f"<{(t := r.choice(['div', 'span', 'p', 'h3', 'h1']))}>{self.say(1, 5, keep, False)}</{t}>"
        if kind == "line":
            return self.mark(r.choice(["&copy; ", "", "", "&middot; "]) + self.words(3, 14) + ".", keep)
        if kind == "para":
            return "".join(f"<p>{self.say(5, 40, keep)}</p>" for _ in range(r.randint(1, 3)))
        if kind == "teasers":
            return "".join(f"<div><h3><a href='x'>{self.say(3, 8, keep, False)}</a></h3><p>{self.say(6, 20, keep)}</p></div>" for _ in range(r.randint(2, 5)))
        if kind == "button":
            return f"<p>{self.say(5, 25, keep)}</p><button>{self.say(1, 2, keep, False)}</button>"
        if kind == "fields":
            return "".join(f"<label>{self.say(1, 3, keep, False)}</label><input name=x>" + (f"<select><option>{self.say(1, 2, keep, False)}<option>{self.say(1, 2, keep, False)}</select>" if r.random() < 0.2 else "<br>" if r.random() < 0.3 else "<p></p>") for _ in range(r.randint(1, 4))) + f"<button>{self.say(1, 2, keep, False)}</button>"
        if kind == "talk":
            t = r.choice(["div", "li", "article", "div"])
            name = r.choice([' class="comment"', "", ' class="reply"', ' class="comment-body"'])
            return (f"<h3>{self.say(1, 3, keep, False)}</h3>" if r.random() < 0.6 else "") + "".join(f"<{t}{name}><{(h := r.choice(['b', 'div', 'cite', 'p']))}>{self.say(1, 3, keep, False)}</{h}><p>{self.say(4, 60, keep)}</p></{t}>" for _ in range(r.randint(1, 6)))
        raise ValueError(kind)

    def chrome(self, kind: str) -> str:
        tags, names, fills = CHROME[kind]
        tag, attr = self.named(tags, names)
        before, self.style = self.style, "plain" if self.r.random() < 0.8 else self.style
        inner = self.fill(self.r.choice(fills))
        if self.r.random() < 0.2:
            inner = f'<div class="{self.noise()}">{inner}</div>'
        self.style = before
        return f"<{tag}{attr}>{inner}</{tag}>"

    def part(self) -> str:
        r, roll = self.r, self.r.random()
        if roll < 0.66:
            if r.random() < 0.2:
                self.style = self.pick()
            text = self.say(1, 3 if r.random() < 0.25 else 120, True)
            if r.random() < 0.12:
                text = text.replace(" ", f" <{(t := r.choice(['b', 'em', 'i', 'span']))}>", 1) + f"</{t}>"
            if r.random() < 0.1:
                text += f' <a href="/{self.word()}">{self.words(1, 3)}</a> ' + self.words(1, 6)
            return f"<p>{text}</p>" if r.random() < 0.93 else f"<p>{text}"
        if roll < 0.74:
            return f"<h{(n := r.randint(2, 4))}>{self.say(1, 8, True, False)}</h{n}>"
        if roll < 0.82:
            return f"<ul>{''.join(f'<li>{self.say(1, 20, True)}</li>' for _ in range(r.randint(2, 6)))}</ul>"
        if roll < 0.87:
            return f"<blockquote><p>{self.say(6, 40, True)}</p></blockquote>"
        if roll < 0.91:
            return "<table>" + "".join(f"<tr><td>{self.say(1, 4, True, False)}</td><td>{self.say(1, 4, True, False)}</td></tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if roll < 0.94:
            return f"<pre>{self.say(3, 20, True, False)}</pre>"
        return f"<p><b>{self.say(3, 12, True)}<br><p>{self.say(5, 60, True)}</p>"

    def page(self) -> str:
        r = self.r
        self.style = self.pick()
        parts = [f"<h1>{self.say(2, 10, True, r.random() < 0.5)}</h1>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        parts += [self.part() for _ in range(r.choice([1, 2, 4, 8, 14, 25]))]
        for kind, chance in (("advert", 0.25), ("share", 0.2), ("notice", 0.1), ("sidebar", 0.12), ("form", 0.06)):
            if r.random() < chance:
                parts.insert(r.randint(0, len(parts)), self.chrome(kind))
        if r.random() < 0.2:
            parts.append(self.chrome("comments"))
        tag, attr = self.named(*BODY)
        body = f"<{tag}{attr}>{''.join(parts)}</{tag}>"
        if r.random() < 0.3:
            outer, more = self.named(*BODY)
            body = f"<{outer}{more}>{body}{self.chrome('comments') if r.random() < 0.3 else ''}</{outer}>"
        if r.random() < 0.04:
            body = ""
        top = [self.chrome(k) for k, c in (("header", 0.5), ("menu", 0.75), ("notice", 0.25), ("advert", 0.4), ("form", 0.2)) if r.random() < c]
        end = [self.chrome(k) for k, c in (("comments", 0.35), ("sidebar", 0.4), ("advert", 0.2), ("share", 0.2), ("form", 0.2), ("footer", 0.8), ("notice", 0.15)) if r.random() < c]
        if r.random() < 0.4:
            r.shuffle(top)
        if r.random() < 0.3:
            r.shuffle(end)
        if r.random() < 0.15 and end:
            top.append(end.pop(r.randrange(len(end))))
        inner = "".join(top) + body + "".join(end)
        if r.random() < 0.3:
            inner = f'<div class="{self.noise()}">{inner}</div>'
        gap = r.choice(["", "\n", "\n  "])
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 4)}</title><style>p{{}}</style></head><body>{inner}</body></html>".replace("><", f">{gap}<")


def labelled(seed: int):
    """Blocks of a made-up page with their labels (a block is article text if its first mark says so)."""
    blocks = blocks_of(Maker(seed).page())
    for b in blocks:
        b.label = int("y\ue001" in b.text.split(" ")[0] or ("y\ue001" in b.text and "n\ue001" not in b.text))
        while "\ue000" in b.text:
            lo, hi = b.text.index("\ue000"), b.text.index("\ue001")
            b.text = b.text[:lo] + b.text[hi + 1 :]
        b.text = b.text or "x"
    return blocks


def step(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
    """Loss and slopes of one batch."""
    runs, out = {}, w["o"][0] + x @ w["ox"]
    for k, flip in (("f", False), ("b", True)):
        xs, ms = (x[:, ::-1], mask[:, ::-1]) if flip else (x, mask)
        n, steps, _ = xs.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        z, kept = xs @ w["w" + k] + w["b" + k], []
        hs = np.zeros((n, steps, HIDDEN))
        for t in range(steps):
            g = z[:, t] + h @ w["u" + k]
            i, f, o, a = _sigmoid(g[:, :HIDDEN]), _sigmoid(g[:, HIDDEN : 2 * HIDDEN]), _sigmoid(g[:, 2 * HIDDEN : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            m = ms[:, t, None]
            c2 = np.where(m, f * c + i * a, c)
            kept.append((h, c, i, f, o, a, c2, m))
            h, c = np.where(m, o * np.tanh(c2), h), c2
            hs[:, t] = h
        runs[k] = (xs, kept, hs)
        out = out + (hs[:, ::-1] if flip else hs) @ w["o" + k]
    p = _sigmoid(out)
    total = mask.sum()
    loss = -(np.log(np.where(y == 1, p, 1 - p) + 1e-9) * mask).sum() / total
    e = (p - y) * mask / total
    g = {"o": np.array([e.sum()]), "ox": np.einsum("nt,ntk->k", e, x)}
    for k, flip in (("f", False), ("b", True)):
        xs, kept, hs = runs[k]
        es = e[:, ::-1] if flip else e
        g["o" + k] = np.einsum("nt,ntk->k", es, hs)
        dh_next, dc_next = np.zeros_like(hs[:, 0]), np.zeros_like(hs[:, 0])
        dz = np.zeros((*xs.shape[:2], 4 * HIDDEN))
        du = np.zeros_like(w["u" + k])
        for t in range(xs.shape[1] - 1, -1, -1):
            h, c, i, f, o, a, c2, m = kept[t]
            dh = es[:, t, None] * w["o" + k] + dh_next
            tc = np.tanh(c2)
            dc = np.where(m, dc_next + dh * o * (1 - tc * tc), 0)
            d = np.concatenate([dc * a * i * (1 - i), dc * c * f * (1 - f), np.where(m, dh * tc * o * (1 - o), 0), dc * i * (1 - a * a)], axis=1)
            dz[:, t] = d
            du += h.T @ d
            dh_next = np.where(m, d @ w["u" + k].T, dh)
            dc_next = np.where(m, dc * f, dc_next)
        g["u" + k], g["b" + k], g["w" + k] = du, dz.sum((0, 1)), np.einsum("ntk,ntj->kj", xs, dz)
    return loss, g


def train(pages: int = 3600, rounds: int = 7, batch: int = 32, seed: int = 1, say=print) -> dict[str, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed))
    data = [(describe(b), np.array([k.label for k in b])) for b in (labelled(i) for i in range(pages)) if 0 < len(b) <= 160]
    data.sort(key=lambda d: len(d[1]))
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    w = {}
    for k in "fb":
        w["w" + k], w["u" + k] = draw.normal(0, 0.08, (INPUTS, 4 * HIDDEN)), draw.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w["b" + k] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["o" + k] = draw.normal(0, 0.2, HIDDEN)
    w["ox"], w["o"] = np.zeros(INPUTS), np.zeros(1)
    first, second, n = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for r in range(rounds):
        losses = []
        for k in draw.permutation(len(groups)):
            some = groups[k]
            steps = max(len(d[1]) for d in some)
            x, y, mask = np.zeros((len(some), steps, INPUTS)), np.zeros((len(some), steps)), np.zeros((len(some), steps), bool)
            for j, (a, b) in enumerate(some):
                x[j, : len(b)], y[j, : len(b)], mask[j, : len(b)] = a, b, True
            loss, g = step(w, x, mask, y)
            losses.append(loss)
            n += 1
            rate = 0.01 * (0.5 if r >= rounds // 2 else 1) * (0.3 if r == rounds - 1 else 1)
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            for key, v in g.items():
                v = v * min(1.0, 5 / (norm + 1e-9))
                first[key] += 0.1 * (v - first[key])
                second[key] += 0.001 * (v * v - second[key])
                w[key] -= rate * (first[key] / (1 - 0.9**n)) / (np.sqrt(second[key] / (1 - 0.999**n)) + 1e-8) + rate * 1e-4 * w[key]
        say(f"round {r}: loss {np.mean(losses):.4f}")
    return w


def accuracy(w: dict[str, np.ndarray], seeds: range) -> float:
    model, right, total = Labeller(w), 0, 0
    for s in seeds:
        b = labelled(s)
        if b:
            p = model.probabilities([describe(b)])[0] >= 0.5
            right += int((p == np.array([k.label for k in b])).sum())
            total += len(b)
    return right / total


def main() -> None:
    w = train()
    print("held-out block accuracy", accuracy(w, range(10**6, 10**6 + 300)))
    np.savez_compressed(Path(__file__).with_name("html_weights.npz"), **{k: v.astype(np.float32) for k, v in w.items()})


if __name__ == "__main__":
    main()
