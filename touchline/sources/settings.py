"""Settings files: nested `name: value` lines over defaults, without a parser from outside."""

from __future__ import annotations


def value_of(text: str):
    """A number, truth value, null, list of values, or text."""
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [value_of(x) for x in text[1:-1].split(",") if x.strip()]
    if text in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def read(text: str) -> dict:
    """Nested dictionaries by indentation; comments and empty lines do not count."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        name, colon, rest = body.strip().partition(":")
        if not colon:
            raise ValueError(f"no name in: {line}")
        while open_[-1][0] >= depth:
            open_.pop()
        if rest.strip():
            open_[-1][1][name.strip()] = value_of(rest)
        else:
            open_[-1][1][name.strip()] = made = {}
            open_.append((depth, made))
    return root


def over(defaults: dict, given: dict) -> dict:
    """Defaults with what is given in their place, level by level; a name that has no default is an error."""
    if unknown := sorted(set(given) - set(defaults)):
        raise KeyError(f"unknown: {', '.join(unknown)}")
    return {k: over(v, given[k] or {}) if isinstance(v, dict) and k in given else given.get(k, v) for k, v in defaults.items()}
