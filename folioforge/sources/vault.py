"""Where a project's vault is, and a new one's folders: files of the driver's machine."""

from __future__ import annotations

from pathlib import Path

from ..operators.graph import LAYERS

# The file that names a project's vault, the note that every vault has, the folders beside its layers.
CONFIG, MARKER = ".claude/vault-path.local", "INSTRUCTIONS-CLAUDE.md"
FOLDERS = ("archives", "inbox", "references", "LOG", *(f"wiki/{x}" for x in LAYERS))


class VaultError(Exception):
    """No usable vault."""


def resolve(start: str, config: str = CONFIG, marker: str = MARKER) -> str:
    """The absolute path of the vault that the nearest configuration file at or above a folder names.

    The file's first line counts, without byte order mark and trailing blanks;
    the folder must exist and hold the marker note.
    """
    here = Path(start).resolve()
    found = next((f for f in (p / config for p in (here, *here.parents)) if f.is_file()), None)
    if found is None:
        raise VaultError(f"no {config} at or above {here}")
    lines = found.read_text(encoding="utf-8-sig").splitlines()
    named = lines[0].rstrip() if lines else ""
    if not named:
        raise VaultError(f"{found} is empty")
    vault = Path(named) if Path(named).is_absolute() else here / named
    if not vault.is_dir():
        raise VaultError(f"no such folder: {vault}")
    if not (vault / marker).is_file():
        raise VaultError(f"{vault} holds no {marker}")
    return str(vault.resolve())


def scaffold(path: str, templates: dict[str, str]) -> list[str]:
    """Makes a vault's folders and those of its files (relative path to text) that are not there yet; what is there stays. Returns what was made."""
    root, made = Path(path), []
    for folder in FOLDERS:
        if not (root / folder).is_dir():
            (root / folder).mkdir(parents=True)
            made.append(folder)
    for name, text in sorted(templates.items()):
        target = root / name
        if not target.resolve().is_relative_to(root.resolve()):
            raise VaultError(f"outside the vault: {name}")
        if not target.exists():
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(text, encoding="utf-8")
            made.append(name)
    return made
