"""A project's folder: its settings, the files that git knows, and single files."""

from __future__ import annotations

import json
import os
import subprocess
from dataclasses import asdict, dataclass, field, fields

from symgraph.functions.names import LANGUAGES
from symgraph.functions.terms import project_tokens
from symgraph.sources.files import EXCLUDE, INCLUDE, MOST_BYTES

FOLDER = ".symgraph"
#: Languages whose symbols are extracted.
PARSED = ("python", "typescript", "tsx", "javascript", "jsx", "go", "rust", "java")


@dataclass
class Settings:
    """What of a project is indexed."""

    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    languages: list[str] = field(default_factory=list)
    max_file_size: int = MOST_BYTES

    @staticmethod
    def load(root: str) -> Settings:
        """Settings of a project; those that its file doesn't have, and all if there is no file, are the usual ones; names it has beyond these are passed over."""
        try:
            with open(os.path.join(root, FOLDER, "config.json"), encoding="utf-8") as f:
                known = json.load(f)
        except FileNotFoundError:
            return Settings()
        return Settings(**{x.name: known[x.name] for x in fields(Settings) if x.name in known})

    def save(self, root: str) -> None:
        os.makedirs(os.path.join(root, FOLDER), exist_ok=True)
        with open(os.path.join(root, FOLDER, "config.json"), "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)


def is_supported(language: str) -> bool:
    """Whether symbols of a language's files are extracted; others have their file node."""
    return language in PARSED


def language_of(path: str) -> str:
    """The same as ``names.language`` for one path."""
    return LANGUAGES.get(path.rsplit("/", 1)[-1].lower().rpartition(".")[2], "unknown")


def git_files(root: str, seconds: int = 30) -> list[str] | None:
    """Paths of tracked files, and of others that aren't ignored; None where root isn't the top of a git work tree, or git takes too long."""

    def ask(*what: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", root, *what], capture_output=True, timeout=seconds, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.decode("utf-8", "surrogateescape") if done.returncode == 0 else None

    top = ask("rev-parse", "--show-toplevel")
    if top is None or os.path.realpath(top.strip()) != os.path.realpath(root):
        return None
    lists = [ask("ls-files", "-z", "-c"), ask("ls-files", "-z", "-o", "--exclude-standard")]
    if None in lists:
        return None
    return sorted({p for x in lists for p in x.split("\0") if p})


class LocalFiles:
    """Reads single files of a project; another provider needs the same two methods."""

    def __init__(self, root: str):
        self.root = os.path.realpath(root)

    def _inside(self, path: str) -> str | None:
        full = os.path.realpath(os.path.join(self.root, path))
        return full if full == self.root or full.startswith(self.root + os.sep) else None

    def exists(self, path: str) -> bool:
        full = self._inside(path)
        return full is not None and os.path.isfile(full)

    def read(self, path: str) -> str | None:
        """The text, or None where there is no such file in the project or it isn't UTF-8."""
        try:
            with open(self._inside(path) or "", encoding="utf-8") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):
            return None

    def name_tokens(self) -> set[str]:
        return project_tokens(os.path.basename(self.root), self.read)
