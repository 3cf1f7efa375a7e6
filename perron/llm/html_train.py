"""Training of the block labeller on composed pages: ``python -m perron.llm.html_train`` writes the weights.

A page is composed of an article and of furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments), each in wrappers of any depth, with class names that say what they
are, that mislead, or that mean nothing. Blocks of the main text begin with a private character,
which is how their labels are known; it is taken away before the labeller sees them.
"""

from __future__ import annotations

import json
import random
import string
import sys
from collections import Counter
from collections.abc import Callable

import numpy as np

from perron.llm import html as H

MARK = "\ue000"
LETTERS = "etaoinshrdlucmfwygpbvkäöüéèñóß"
COMMON = (
    "the of and to in is that for it with on was he are as be this have from or by not but they which you were all her she there would their we him been has when who will more no if out so said what up its about into than them can only other "
    "der die und den das von mit ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei noch wie einem um am sind "
    "le la les des et en un que du une dans est pour qui par sur au plus pas il sont ce avec se son "
    "el los de y por con se para del las una su al lo como más pero sus este entre"
).split()
#: Words of furniture. They occur in articles too, rarely.
SAID = {
    "menu": "Home|About|About us|Contact|News|Sports|Politics|Business|Blog|Archive|Shop|Products|Services|Login|Sign in|Search|Help|FAQ|Menu|Startseite|Kontakt|Impressum|Über uns|Nachrichten|Accueil|Actualités|Inicio|Contacto|Next|Previous|Skip to content|World|Culture|Opinion|Weather|Video|More",
    "header": "Your daily source of news|Welcome to our site|News and views since 1985|The best stories every day|Live updates|Breaking news|Tagline of the site|Free and independent",
    "footer": "All rights reserved.|Copyright 2024|© 2023 Example Inc.|Privacy policy|Terms of use|Imprint|Powered by WordPress|Terms and conditions apply.|Alle Rechte vorbehalten.|Datenschutz|Tous droits réservés.|Mentions légales|Aviso legal|Made with love|Contact the editors",
    "aside": "Related posts|You may also like|Popular articles|Most read|Recent posts|Categories|Tags|Archives|Trending now|Recommended for you|About the author|Follow us|More from this section|Editor's picks|Latest comments",
    "notice": "We use cookies to improve your experience.|This website uses cookies.|By continuing to use this site you accept cookies.|Accept all|Decline|Subscribe to our newsletter|Sign up now|You have reached your limit of free articles.|Please enable JavaScript.|Wir verwenden Cookies.|Ce site utilise des cookies.|Utilizamos cookies.|Register for free to read on.|Close",
    "ad": "Advertisement|Sponsored|Buy now|Special offer|Save 50% today|Limited time only|Get it here|Anzeige|Publicité|Publicidad|Click here|Order today and save|Free shipping|Paid content",
    "form": "Search|Email|Your name|Password|Send|Submit|Message|Remember me|Subject|Name|Log in|Phone|Your email address|Required fields are marked",
    "comments": "Reply|Leave a comment|Comments|says:|Great article!|Thanks for sharing.|I disagree with this.|Report|Like|Permalink|Log in to reply|Kommentare|Antworten|Commentaires|Comentarios|Load more comments|5 comments|2 hours ago",
    "share": "Share|Tweet|Facebook|Twitter|Email this|Print|Share this|Tags:|Filed under|Posted in|Teilen|Partager|Compartir|WhatsApp|Copy link",
}
SAID = {k: v.split("|") for k, v in SAID.items()}
NAMES = {
    "menu": "menu nav navbar navigation main-nav site-nav topnav breadcrumbs breadcrumb menu-main primary-menu main-menu nav-links navlist tabs mega-menu offcanvas subnav pager pagination post-navigation toc-nav skip-link",
    "header": "header site-header page-header masthead topbar banner logo branding site-branding header-content top-header site-title tagline head-wrap hero-nav",
    "footer": "footer site-footer page-footer copyright legal colophon footer-widgets footer-content footer-inner bottom-bar site-info imprint credits",
    "aside": "sidebar side-bar widget widget-area related related-posts recommended secondary sidebar-primary sidebar-inner widget-content right-rail rail trending popular most-read author-box about-author similar teaser-list aside latest-posts",
    "notice": "cookie cookie-notice cookie-banner cookies consent gdpr notice alert popup modal newsletter subscribe overlay paywall cookie-text modal-content cookie-bar privacy-notice notification signup-box subscription toast announcement",
    "ad": "ad ads advert advertisement sponsored sponsor promo ad-slot adsbygoogle ad-container ad-content advertising banner-ad google-ads dfp-ad adbox promo-box sponsored-content native-ad commercial",
    "form": "search search-form login login-form signup contact-form form form-group searchbox register newsletter-form comment-form",
    "comments": "comments comment-list comments-area reader-comments discussion replies responses disqus_thread comment-section comments-wrapper user-comments respond",
    "share": "share social tags meta byline-links toolbar share-buttons social-links entry-meta post-meta entry-footer post-tags sharing sharedaddy article-share tag-list post-footer actions",
}
NAMES = {k: v.split() for k, v in NAMES.items()}
#: Names of elements around the main text, and names around anything.
MAIN = "content post-content entry main article-body article post entry-content story story-body body text article-text single-post main-content primary post-body page-content articleBody article__body richtext prose hentry node-content site-main content-area field-body post-single the-content markdown-body mw-content-text".split()
ANY = "wrapper container row col inner page site app root layout wrap outer grid box center left right section block group panel clearfix module component site-content page-wrapper col-md-8 container-fluid".split()
#: Names of elements around the article together with furniture; they speak of both.
BOTH = "content-sidebar-wrap has-sidebar with-sidebar content-with-aside main-and-sidebar no-header two-columns layout-sidebar content-wrap comments-open page-with-nav with-comments has-ads".split()


class Composer:
    """Pages made up at random."""

    def __init__(self, rng: random.Random):
        self.rng, self.pick = rng, rng.choice
        self.tongue = 0.35

    def word(self) -> str:
        if self.rng.random() < self.tongue:
            return self.pick(COMMON)
        return "".join(self.rng.choices(LETTERS, weights=range(len(LETTERS), 0, -1), k=self.rng.randint(2, 10)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(a, b)))

    def sentence(self, a: int = 4, b: int = 18) -> str:
        t = self.words(a, b).capitalize()
        if self.rng.random() < 0.02:
            t += " " + self.pick(self.pick(list(SAID.values()))).lower()
        if self.rng.random() < 0.3:
            t = t.replace(" ", ", ", 1)
        return t + self.pick(".....!?")

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, 7)))

    def oddname(self) -> str:
        r = self.rng
        return self.pick(("", "", "css-", "sc-", "x", "Layout_", "js-")) + "".join(r.choices(string.ascii_lowercase + "0123456789", k=r.randint(2, 7)))

    def attribute(self, *names: str) -> str:
        """A class, id or role with the given names, mixed with odd ones."""
        if not names:
            return ""
        mixed = [*names, *[self.oddname() for _ in range(self.rng.choice((0, 0, 0, 1, 2, 8)))]]
        self.rng.shuffle(mixed)
        text = " ".join(mixed)
        kind = self.pick(("class", "class", "class", "id"))
        return f' {kind}="{text}"' if self.rng.random() < 0.9 else f" {kind}='{text}' data-x=\"{self.oddname()}\""

    def wrapped(self, inner: str, most: int, names: list[str], share: float) -> str:
        """``inner`` in up to ``most`` elements, some of them with one of the names."""
        for _ in range(self.rng.randint(0, most)):
            x = self.rng.random()
            name = self.pick(names) if x < share else self.pick(ANY) if x < share + 0.25 else self.oddname() if x < share + 0.45 else None
            tag = self.pick(("div", "div", "div", "div", "section", "center", "table"))
            if tag == "table":
                inner = f"<table{self.attribute(*[name] if name else [])}><tr><td>{inner}</td></tr></table>"
            else:
                inner = f"<{tag}{self.attribute(*[name] if name else [])}>{inner}</{tag}>"
        return inner

    def links(self, n: int, tag: str | None = None, said: str = "menu") -> str:
        tag = tag or self.pick(("li", "li", "span", "div", "td", ""))
        text = lambda: self.pick(SAID[said]) if self.rng.random() < 0.5 else self.words(1, 4)
        each = [f'<a href="/{self.oddname()}">{text()}</a>' for _ in range(n)]
        return "".join(f"<{tag}>{a}</{tag}>" for a in each) if tag else self.pick((" | ", " ", " &middot; ")).join(each)

    # --- the article -----------------------------------------------------------------------------

    def main_block(self, tag: str, text: str, inner: str | None = None, attribute: str = "") -> str:
        close = "" if tag in ("p", "li") and self.rng.random() < 0.15 else f"</{tag}>"
        return f"<{tag}{attribute}>{MARK}{inner or text}{close}"

    def rich(self, text: str) -> str:
        """A paragraph's text with inline markup."""
        first, _, rest = text.partition(" ")
        words = text.split()
        k = self.rng.randint(0, len(words) - 1)
        linked = " ".join([*words[:k], f'<a href="http://x.example/{self.oddname()}">{" ".join(words[k : k + 3])}</a>', *words[k + 3 :]])
        return self.pick((text, text, text, f"<b>{first}</b> {rest}", f"<b>{text}<br>", linked, f"{first} <em>{rest}</em>", text.replace(". ", ".<br><br>", 1), f"<span>{text}</span>", f'<span class="{self.oddname()}">{first}</span> {rest}', text.replace(" ", "&nbsp;", 1)))

    def article(self) -> str:
        r, out, block = self.rng, [], self.main_block
        tiny = r.randint(1, 4) if r.random() < 0.15 else 0
        style = self.pick(("p", "p", "p", "p", "p", "div", "bare"))
        if r.random() < 0.85:
            title = block(self.pick(("h1", "h1", "h1", "h2")), "", self.pick((self.words(2, 9).capitalize(), self.sentence())), self.pick(("", "", self.attribute(self.pick(("entry-title", "title", "headline", "post-title", self.oddname()))))))
            out.append(self.pick((title, title, title, f'<header{self.pick(("", self.attribute("entry-header"), self.attribute("post-header")))}>{title}</header>', f"<div{self.attribute(self.oddname())}>{title}</div>")))
        for _ in range(r.randint(1, 10) if r.random() < 0.9 else r.randint(10, 40)):
            kind = r.random()
            if kind < 0.66:
                text = self.pick((self.paragraph, self.sentence, self.paragraph))() if not tiny else self.sentence(1, tiny)
                inner = self.rich(text)
                if style == "bare":
                    out.append(f"{MARK}{inner}<hr>")
                elif style == "div":
                    out.append(block("div", "", inner, self.pick(("", self.attribute(self.oddname()), self.attribute(self.pick(("paragraph", "text-block", "text", "body-text", "para")))))))
                else:
                    out.append(self.wrapped(block("p", "", inner, self.pick(("", "", "", "", self.attribute(self.oddname())))), 2 if r.random() < 0.1 else 0, MAIN, 0.2))
            elif kind < 0.75:
                out.append(block(self.pick(("h2", "h3", "h4")), "", self.words(1, 6).capitalize()))
            elif kind < 0.83:
                tag = self.pick(("ul", "ol"))
                items = "".join(block("li", "", self.rich(self.pick((self.words(1, 6), self.sentence(), self.paragraph())))) for _ in range(r.randint(2, 6)))
                out.append(f"<{tag}>{items}</{tag}>")
            elif kind < 0.88:
                out.append(self.pick((lambda: block("blockquote", "", self.paragraph()), lambda: f"<blockquote>{block('p', '', self.paragraph())}</blockquote>"))())
            elif kind < 0.91:
                out.append(block("pre", "", self.words(3, 20)))
            elif kind < 0.94:
                cells = lambda tag: "".join(block(tag, "", self.words(1, 3)) for _ in range(3))
                out.append(f"<table>{'<tr>' + cells('th') + '</tr>' if r.random() < 0.5 else ''}" + "".join(f"<tr>{cells('td')}</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.955:
                out.append(f'<figure><img src="x.png" alt="{self.words(1, 4)}">{block("figcaption", "", self.sentence())}</figure>')
            elif kind < 0.97:
                out.append(f"<dl>{block('dt', '', self.words(1, 3))}{block('dd', '', self.sentence())}</dl>")
            elif len(out) > 1:
                out.append(self.pick((self.furniture["ad"], self.furniture["aside"], self.furniture["share"], self.furniture["notice"]))())
        if tiny or len(out) < 2:
            out.append(block("p", "", self.paragraph() if not tiny else self.sentence(1, tiny)))
        body = "".join(out)
        if r.random() < 0.12:
            body += "".join(self.furniture[k]() for k in ("share", "aside", "comments", "ad") if r.random() < 0.4)
        return body

    # --- furniture -------------------------------------------------------------------------------

    @property
    def furniture(self) -> dict[str, Callable[[], str]]:
        return {"menu": self.menu, "header": self.header, "footer": self.footer, "aside": self.aside, "notice": self.notice, "ad": self.ad, "form": self.form, "comments": self.comments, "share": self.share}

    def said(self, kind: str) -> str:
        """Text of some furniture: its usual words or any."""
        usual = self.pick(SAID[kind])
        return self.pick((lambda: usual, lambda: f"{usual} {self.sentence()}", self.sentence, self.paragraph, lambda: self.words(1, 4)))()

    def lines(self, kind: str) -> str:
        """One to three lines of it."""
        return "".join(f"<{t}>{self.said(kind)}</{t}>" for t in (self.pick(("p", "p", "div", "span", "h3", "li")) for _ in range(self.rng.randint(1, 3))))

    def named(self, kind: str, inner: str, tag: str | None, bare: float = 0.0) -> str:
        """An element that shows by its tag or by a name what it is, with wrappers inside and outside."""
        if self.rng.random() < bare:
            return inner
        inner = self.wrapped(inner, self.pick((0, 0, 0, 1, 3)), MAIN if self.rng.random() < 0.15 else ANY, 0.15)
        name = self.pick(NAMES[kind])
        if tag and self.rng.random() < 0.5:
            out = f"<{tag}{self.pick(('', '', self.attribute(name), self.attribute(self.oddname())))}>{inner}</{tag}>"
        else:
            t = self.pick(("div", "div", "div", "section", "ul" if inner.startswith("<li") else "div"))
            out = f"<{t}{self.attribute(name)}>{inner}</{t}>"
        return self.wrapped(out, self.pick((0, 0, 1, 3, 6)), ANY, 0.15)

    def menu(self) -> str:
        n = self.rng.randint(2, 9)
        inner = self.pick((f"<ul>{self.links(n, 'li')}</ul>", self.links(n)))
        return self.named("menu", inner, "nav", 0.2)

    def header(self) -> str:
        title = self.pick((lambda: f"<h1{self.attribute('site-title')}><a href='/'>{self.words(1, 4)}</a></h1>", lambda: f"<h2>{self.words(1, 4)}</h2>", lambda: f"<a href='/'>{self.words(1, 3)}</a>", lambda: f"<span>{self.words(1, 4)}</span>", lambda: ""))()
        return self.named("header", title + self.pick((self.lines("header"), "", self.menu())) or self.said("header"), "header")

    def footer(self) -> str:
        sign = f"&copy; {self.pick(('', '2024 ', '2019 '))}{self.word()}.example.com &middot; {self.said('footer')}"
        inner = self.pick((lambda: sign, lambda: f"<p>{sign}</p>", lambda: self.lines("footer"), lambda: f"{self.lines('footer')}<ul>{self.links(3, 'li', 'footer')}</ul>", lambda: f"{self.links(4, said='footer')}<p>{sign}</p>"))()
        return self.named("footer", inner, "footer")

    def aside(self) -> str:
        title = f"<h3>{self.pick(SAID['aside']) if self.rng.random() < 0.6 else self.words(1, 3)}</h3>"
        teaser = lambda: f"<div><h4><a href='/x'>{self.words(2, 7)}</a></h4><p>{self.pick((self.sentence, self.paragraph))()}</p></div>"
        inner = title + self.pick((lambda: f"<ul>{self.links(self.rng.randint(2, 6), 'li', 'aside')}</ul>", lambda: f"<p>{self.paragraph()}</p>", lambda: "".join(teaser() for _ in range(3)), lambda: self.links(4, said="aside")))()
        return self.named("aside", inner, "aside")

    def notice(self) -> str:
        if self.rng.random() < 0.15:
            return f'<div role="{self.pick(("alert", "dialog", "banner", "alertdialog", "complementary"))}">{self.lines("notice")}</div>'
        return self.named("notice", self.lines("notice") + self.pick(("", f"<button>{self.pick(SAID['notice'])}</button>", f"<a href='#'>{self.pick(SAID['notice'])}</a>")), None)

    def ad(self) -> str:
        if self.rng.random() < 0.2:
            return f'<!-- ad {self.rng.randint(0, 9)} --><{self.pick(("ins", "div"))} class="{self.pick(("adsbygoogle", "ad"))}">{self.sentence()}</{self.pick(("ins", "div"))}>'
        return self.named("ad", self.pick((self.said("ad"), self.lines("ad"), f"<a href='http://buy.example'>{self.said('ad')}</a>", f"<h3>{self.words(1, 4)}</h3><p>{self.paragraph()}</p>")), None)

    def form(self) -> str:
        label = lambda: self.pick(SAID["form"]) if self.rng.random() < 0.6 else self.words(1, 3)
        field_ = lambda: self.pick((f"<label>{label()}</label><input name=a>", f"<label>{label()} <input></label>", f"<select><option>{self.word()}</option><option>{self.word()}</option></select>", f"<textarea>{self.words(1, 4)}</textarea>", f"<p>{self.sentence()}</p>", f"<fieldset><legend>{label()}</legend></fieldset>"))
        inner = "".join(field_() for _ in range(self.rng.randint(1, 4))) + f"<button>{label()}</button>"
        out = f"<form{self.pick(('', self.attribute(self.pick(NAMES['form']))))}>{inner}</form>"
        return self.wrapped(out, 3, NAMES["form"] + ANY, 0.4)

    def comment(self, depth: int = 0) -> str:
        tag, box = self.pick((("div", "div"), ("li", "article"), ("li", "div"), ("article", "div"), ("div", "p")))
        who = f"<{self.pick(('b', 'cite', 'span', 'div', 'strong', 'h4'))}>{self.word()}</b> {self.pick(SAID['comments'])}"
        text = f"<p>{self.said('comments')}</p>" + (f"<p>{self.paragraph()}</p>" if self.rng.random() < 0.4 else "")
        inner = f"<{box}{self.pick(('', self.attribute('comment-body'), self.attribute('comment-content'), self.attribute(self.oddname())))}>{who}{text}</{box}>"
        if depth < 9 and self.rng.random() < 0.3:
            inner += f"<{self.pick(('ul', 'ol', 'div'))}{self.pick(('', self.attribute('children'), self.attribute('replies')))}>{self.comment(depth + 1)}</ul>"
        return f"<{tag}{self.attribute(self.pick(('comment', 'reply', 'comment-body', 'comment-item', 'comment depth')))}>{inner}</{tag}>"

    def comments(self) -> str:
        title = self.pick(("", f"<h3>{self.said('comments')}</h3>", f"<h2>{self.rng.randint(1, 99)} {self.pick(SAID['comments'])}</h2>"))
        inner = title + "".join(self.comment() for _ in range(self.rng.randint(1, 5)))
        if self.rng.random() < 0.3:
            inner += self.form()
        tag = self.pick(("div", "section", "ol", "aside"))
        return self.wrapped(f"<{tag}{self.attribute(self.pick(NAMES['comments']))}>{inner}</{tag}>", self.pick((0, 0, 1, 3)), ANY, 0.2)

    def share(self) -> str:
        return self.named("share", self.pick((self.links(self.rng.randint(2, 5), said="share"), self.said("share"), f"<span>{self.said('share')}</span>{self.links(2, 'span', 'share')}")), None)

    # --- the page --------------------------------------------------------------------------------

    def page(self) -> str:
        r, pick = self.rng, self.pick
        self.tongue = pick((0.0, 0.2, 0.35, 0.5))
        much = pick((0.15, 0.4, 0.4, 0.7))
        before = [self.furniture[k]() for k in ("header", "menu", "notice", "ad", "form", "aside", "share") if r.random() < much]
        after = [self.furniture[k]() for k in ("share", "comments", "aside", "ad", "form", "menu", "notice", "footer") if r.random() < much]
        if r.random() < 0.5:
            r.shuffle(before)
        body = self.article()
        most = pick((0, 0, 1, 3, 6, 15))
        tag = pick(("article", "article", "article", "main", "section", "div", "div", ""))
        inner = self.wrapped(body, pick((0, 0, 0, 1, 3, 15)), MAIN, 0.4)
        if tag:
            name = pick(MAIN) if r.random() < (0.8 if tag in ("div", "section") else 0.4) else None
            inner = f"<{tag}{self.attribute(*[name] if name else [])}>{inner}</{tag}>"
        if r.random() < 0.25 and after:
            inner += after.pop(0)
        inner = self.wrapped(inner, most, MAIN, 0.25)
        if r.random() < 0.2:
            beside = self.aside()
            inner = f"<div{self.attribute(pick(BOTH))}>{pick((inner + beside, beside + inner))}</div>"
        whole = "".join(before) + inner + "".join(after)
        if r.random() < 0.1 and before:
            whole = f"<table><tr><td>{''.join(before)}</td><td>{inner}</td></tr><tr><td>{''.join(after)}</td></tr></table>"
        whole = self.wrapped(whole, pick((0, 0, 1, 3)), ANY + BOTH, 0.3)
        attributes = pick(("", self.attribute(pick(BOTH), "home")))
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{pick((head, head, ''))}<body{attributes}>{whole}</body></html>"


def tokens_of(pages: int, seed: int, least: int = 6) -> list[str]:
    """The vocabulary: what occurs often enough in the tags of composed pages."""
    every, composer = Counter(), Composer(random.Random(seed))
    words = {w for names in [*NAMES.values(), MAIN, ANY, BOTH] for n in names for w in H.WORD.findall(H.CAMEL.sub(r"\1 \2", n).lower())}
    for _ in range(pages):
        for m in H.TAG.finditer(composer.page()):
            if not m[1]:
                every[m[2].lower()] += 1
    return sorted(t for t, k in every.items() if k >= least and t not in H.PLAIN) + sorted("." + w for w in words | {"alert", "dialog", "banner", "complementary", "comment", "reply", "children", "title", "headline", "paragraph", "text", "para"})


def composed(pages: int, seed: int, vocabulary: H.Vocabulary) -> list[tuple[H.Page, np.ndarray]]:
    """Pages as the labeller sees them, and the labels of their blocks."""
    composer, out = Composer(random.Random(seed)), []
    for _ in range(pages):
        blocks = H.parse_blocks(composer.page(), vocabulary)
        y = np.array([b.text.startswith(MARK) for b in blocks], dtype=np.float32)
        for b in blocks:
            b.text = b.text.replace(MARK, "").strip() or "."
        out.append((H.features(blocks), y))
    return [x for x in out if len(x[1])]


def gradients(p: H.Padded, target: np.ndarray, w: dict) -> tuple[float, dict]:
    """Cross-entropy and its gradients by back-propagation through time."""
    x = H.embed(p, w)
    tapes: dict[str, list] = {"f": [], "b": []}
    hs = {d: H.run_direction(x, p.mask, w, d, tapes[d]) for d in "fb"}
    h = np.concatenate((hs["f"], hs["b"]), axis=2)
    y = H.sigmoid(h @ w["out"] + w["out_bias"])
    m = p.mask[:, :, 0]
    loss = -float((m * (target * np.log(y + 1e-7) + (1 - target) * np.log(1 - y + 1e-7))).sum() / m.sum())
    dy = (m * (y - target) / m.sum()).astype(np.float32)
    g = {"out": np.einsum("tn,tnh->h", dy, h), "out_bias": np.array([dy.sum()], np.float32)}
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        dout = dy[:, :, None] * w["out"][k * H.HIDDEN : (k + 1) * H.HIDDEN]
        gx, gh, gc = np.zeros_like(w[f"x{d}"]), np.zeros_like(w[f"h{d}"]), np.zeros_like(w[f"c{d}"])
        dh, dc = np.zeros((p.pages, H.HIDDEN), np.float32), np.zeros((p.pages, H.HIDDEN), np.float32)
        for t, h0, c0, i, f, o, gg, tc, mk in reversed(tapes[d]):
            dh = dh + dout[t]
            dhn, dcn = dh * mk, dc * mk
            do = dhn * tc
            dcn = dcn + dhn * o * (1 - tc * tc)
            dz = np.concatenate((dcn * gg * i * (1 - i), dcn * c0 * f * (1 - f), do * o * (1 - o), dcn * i * (1 - gg * gg)), axis=1)
            gx += x[t].T @ dz
            gh += h0.T @ dz
            gc += dz.sum(0)
            dx[t] += dz @ w[f"x{d}"].T
            dh, dc = dh * (1 - mk) + dz @ w[f"h{d}"].T, dc * (1 - mk) + dcn * f
        g |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
    e = x.reshape(-1, H.EMBEDDED)[p.place]
    de = dx.reshape(-1, H.EMBEDDED)[p.place] * (1 - e * e)
    g["bias"], g["measure"] = de.sum(0), p.measured.T @ de
    n = np.diff(p.offsets)
    g["word"] = np.zeros_like(w["word"])
    np.add.at(g["word"], p.words, np.repeat(de / np.maximum(n, 1)[:, None].astype(np.float32), n, axis=0))
    for k in range(3):
        _, which, rows, most = H.pooled(w[f"path{k}"], [s[k] for s in p.paths])
        each = np.zeros((len(rows), H.EMBEDDED), np.float32)
        np.add.at(each, which, de)
        table = np.zeros_like(w[f"path{k}"])
        np.add.at(table, (np.take_along_axis(rows, most, axis=1), np.arange(H.EMBEDDED)), each)
        g[f"path{k}"] = table
    return loss, g


def train(pages: int = 6000, epochs: int = 12, seed: int = 3, report: Callable[[str], None] = print) -> tuple[dict[str, np.ndarray], list[str]]:
    """Weights after Adam on composed pages, and the vocabulary; the seed fixes pages, start and order."""
    tokens = tokens_of(300, seed)
    vocabulary = H.Vocabulary(tokens)
    data = composed(pages, seed, vocabulary)
    w = H.new_weights(seed, len(tokens))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    by_length = sorted(range(len(data)), key=lambda i: len(data[i][1]))
    batches = [by_length[i : i + 30] for i in range(0, len(by_length), 30)]
    for epoch in range(epochs):
        total = 0.0
        for b in rng.permutation(len(batches)):
            p = H.padded([data[i][0] for i in batches[b]])
            target = np.zeros(p.steps * p.pages, np.float32)
            target[p.place] = np.concatenate([data[i][1] for i in batches[b]])
            loss, g = gradients(p, target.reshape(p.steps, p.pages), w)
            total += loss
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k in w:
                d = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                w[k] -= (0.01 * (1 - epoch / epochs) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        report(f"epoch {epoch}: loss {total / len(batches):.4f}")
    return w, tokens


def accuracy(w: dict[str, np.ndarray], tokens: list[str], pages: int = 500, seed: int = 77) -> float:
    """Share of right blocks on composed pages of another seed."""
    held = composed(pages, seed, H.Vocabulary(tokens))
    right = [((y >= H.THRESHOLD) == (t > 0.5)).sum() for y, (_, t) in zip(H.label([x for x, _ in held], w), held, strict=True)]
    return float(sum(right) / sum(len(t) for _, t in held))


def main() -> None:
    w, tokens = train(*map(int, sys.argv[1:3]))
    print("held-out accuracy", accuracy(w, tokens))
    np.savez_compressed(H.WEIGHTS, tokens=np.frombuffer(json.dumps(tokens).encode(), np.uint8), **{k: v.astype(np.float16) for k, v in w.items()})


if __name__ == "__main__":
    main()
