"""Select lists written once for both engines."""


def columns(text: str) -> list[str]:
    """A select list's items: commas outside brackets part them."""
    out, depth = [""], 0
    for mark in text.replace("\n", " "):
        depth += (mark in "([") - (mark in ")]")
        if mark == "," and not depth:
            out.append("")
        else:
            out[-1] += mark
    return out
