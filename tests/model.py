"""An independent model of the filters over bytes, for comparison with the Spark expressions."""

import re

BLANKS = b" \t\n\r\f\x0b"
PUNCT = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
POLICY = [b"terms of use", b"privacy policy", b"cookie policy", b"uses cookies", b"use of cookies", b"use cookies"]
STOPS = {b"the", b"be", b"to", b"of", b"and", b"that", b"have", b"with"}


def words(b):
    return [w for w in re.split(b"[ \t\n\r\f\x0b]+", b) if w]


def low(b):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in b)


def c4(text):
    raw, kept = text.encode(), []
    for line in raw.split(b"\n"):
        if line.endswith(b"\r"):
            line = line[:-1]
        line = line.strip(b" \t")
        if not line or any(len(w) > 1000 for w in words(line)):
            continue
        line = re.sub(rb"\[(?:citation needed|edit|[0-9]*)\]", b"", line).strip(b" \t")
        if not line or len(words(line)) < 5 or line[-1:] not in (b".", b"?", b"!", b'"', b"'") or line.endswith(b"..."):
            continue
        small = low(line)
        if b"lorem ipsum" in small:
            return "lorem_ipsum", text
        if b"javascript" in small:
            continue
        if b"{" in line:
            return "curly_bracket", text
        if any(p in small for p in POLICY):
            continue
        kept.append(line)
    return ("too_few_sentences", text) if len(kept) < 5 else ("", b"\n".join(kept).decode())


def paragraphs(text):
    b = text.encode()
    lines = b.split(b"\n") if b else []
    if lines and lines[-1] == b"":
        lines.pop()
    sizes = sorted((len(x[:-1] if x.endswith(b"\r") else x) for x in lines), reverse=True)
    if len(sizes) < 3:
        return "< min_paragraphs"
    return "top 3 paragraphs too short" if sizes[2] < 200 else ""


def bad_word(text, entries):
    b = low(text.encode())
    alnum = lambda i: 0 <= i < len(b) and bytes([b[i]]).isalnum()
    for e in entries:
        w, at = e.encode(), -1
        while w and (at := b.find(w, at + 1)) >= 0:
            if not alnum(at - 1) and not alnum(at + len(w)):
                return f"badword: {e}"
    return ""


def pipeline(text, entries=("porn", "xxx", "sex")):
    if text == "":
        return "empty_text"
    reason, out = c4(text)
    return reason or paragraphs(out) or bad_word(out, entries)


def gopher(text):
    b = text.encode()
    w = words(b)
    real = [x for x in w if any(c not in PUNCT for c in x)]
    if not w or len(real) < 50:
        return "gopher_short_doc"
    if len(real) > 100_000:
        return "gopher_long_doc"
    avg = sum(map(len, real)) / len(real)
    if avg < 3:
        return "gopher_below_avg_threshold"
    if avg > 10:
        return "gopher_above_avg_threshold"
    if b.count(b"#") / len(w) > 0.1:
        return "gopher_too_many_hashes"
    if len(re.findall("\\.\\.\\.|…".encode(), b)) / len(w) > 0.1:
        return "gopher_too_many_ellipsis"
    lines = b.split(b"\n")
    if sum(x.lstrip(BLANKS).startswith((b"-", "•".encode())) for x in lines) / len(lines) > 0.9:
        return "gopher_too_many_bullets"
    if sum(x.rstrip(BLANKS).endswith((b"...", "…".encode())) for x in lines) / len(lines) > 0.3:
        return "gopher_too_many_end_ellipsis"
    if sum(bool(re.search(b"[A-Za-z]", x)) for x in w) / len(w) < 0.8:
        return "gopher_below_alpha_threshold"
    return "gopher_enough_stop_words" if sum(x in STOPS for x in w) < 2 else ""
