"""Independent oracles for the string rules: character scanners, no regular expressions."""

LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def first_label(text, labels, default="unk"):
    """Label of the first word (bare of full stops and commas at its ends) that has one."""
    word, found = "", []
    for ch in text.lower() + " ":
        if not ch.isspace():
            word += ch
            continue
        while word and word[0] in ".,":
            word = word[1:]
        while word and word[-1] in ".,":
            word = word[:-1]
        found += [labels[word]] if word in labels else []
        word = ""
    return found[0] if found else default


def first_sentence(text):
    """The first line's text up to a full stop, after numbers with the character behind each are left out."""
    if text == "":
        return None
    end = next((i for i, ch in enumerate(text) if ch in LINE_ENDS), len(text))
    kept, i = [], 0
    while i < end:
        j = i
        while j < end and text[j] in "0123456789":
            j += 1
        if j == i:
            kept.append(text[i])
            i += 1
        elif j < end:           # digits and one character behind them
            i = j + 1
        elif j - i > 1:         # digits up to the line's end: the last is the character behind
            i = j
        else:                   # one digit at the end has nothing behind it
            kept.append(text[i])
            i = j
    cut = "".join(kept).partition(".")[0]
    return cut.strip()


def runs(values):
    """(is_new, run_no) per position for the consecutive-equal rule."""
    out, prev, n, first = [], None, 0, True
    for v in values:
        new = first or v is None or prev is None or v != prev
        first = False
        if new:
            n += 1
        out.append((new, n))
        prev = v
    return out
