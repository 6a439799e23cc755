"""Results as text for a terminal."""

from __future__ import annotations

from codelens.engine import SearchResponse

BOLD, RED, GREEN, PLAIN = "\x1b[1m", "\x1b[31m", "\x1b[32m", "\x1b[0m"


def coloured(content: str, highlights: list[tuple[int, int]] | None, colour: str = RED) -> str:
    """A line with colour around its highlights (bytes)."""
    data, out, at = content.encode(), b"", 0
    for start, end in highlights or []:
        out += data[at:start] + colour.encode() + data[start:end] + PLAIN.encode()
        at = end
    return (out + data[at:]).decode(errors="replace")


def text(response: SearchResponse, colour: bool = True) -> str:
    """Repositories, their documents and lines; line numbers from 1."""
    bold, green, plain = (BOLD, GREEN, PLAIN) if colour else ("", "", "")
    out = [f"{response.totals['numDocuments']} documents in {response.totals['numRepos']} repositories"]
    for repo in response.nested().collect():
        r = repo.asDict(recursive=True)
        out.append(f"{bold}{r.get('remote_url') or r.get('local_path') or '(no repository)'}{plain}")
        for d in r.get("documents") or []:
            out.append(f"  {green}{d['filename']}{plain} ({d['n_sections']})")
            for line in d.get("lines") or []:
                spans = [(h["start"], h["end"]) for h in line.get("highlights") or []]
                body = (line.get("content") or "").rstrip("\n")
                out.append(f"    {line['line_no'] + 1}: {coloured(body, spans) if colour else body}")
    return "\n".join(out)
