"""The record of a run: sections of scalars and lists as plain YAML, kept by the driver."""

from __future__ import annotations

Value = str | int | float | bool | None | list


def _quote(v: Value) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    plain = v and v == v.strip() and not any(c in v for c in ":#'\"\n[]{},&*!|>%@`") and _unquote(v) == v
    return v if plain else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _unquote(text: str) -> Value:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        out, i = "", 1
        while i < len(text) - 1:
            if text[i] == "\\":
                i += 1
                out += {"n": "\n"}.get(text[i], text[i])
            else:
                out += text[i]
            i += 1
        return out
    if text in ("null", "", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def dump(sections: dict[str, dict[str, Value]]) -> str:
    lines: list[str] = []
    for section, values in sections.items():
        lines.append(f"{section}:")
        for key, v in values.items():
            if isinstance(v, list):
                lines += [f"  {key}:", *(f"    - {_quote(x)}" for x in v)]
            else:
                lines.append(f"  {key}: {_quote(v)}")
    return "\n".join(lines) + "\n"


def load(text: str) -> dict[str, dict[str, Value]]:
    """What :func:`dump` wrote; blank lines and comments are skipped."""
    out: dict[str, dict[str, Value]] = {}
    section = key = ""
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if not line.startswith(" "):
            section = bare.rstrip(":")
            out[section] = {}
        elif bare.startswith("- "):
            if not isinstance(out[section][key], list):
                out[section][key] = []
            out[section][key].append(_unquote(bare[2:]))
        else:
            key, _, v = bare.partition(":")
            out[section][key] = _unquote(v)
    return out


def may_resume(before: dict[str, dict[str, Value]], genome: str) -> bool:
    """Whether a folder's earlier run was on the same genome, so that it may go on."""
    return before.get("input", {}).get("genome") in (None, genome)
