"""``python -m resemblage.cli analyze PATH``: reports on the functions of a source tree."""

from __future__ import annotations

import argparse
import logging
import sys

from . import config
from .analysis import analyse_tree
from .session import local_session
from .sinks import report

_SHORT = {"threshold": "-t", "top": "-n", "model": "-m", "output": "-o"}
_HELP = {
    "threshold": "least similarity of a reported pair", "top": "most pairs to report; 0 for all", "model": "embedding model", "ollama_url": "base URL of the model service",
    "cache": "JSON file of embeddings; empty for none", "max_input": "most bytes of a function's concept text that are embedded", "ollama_num_ctx": "context length to ask for; 0 for the server's",
    "reflect_model": "chat model that explains pairs; empty for none", "output": "Markdown report to write", "concept_model": "ignored", "config": f"JSON settings (default: {config.FILE})",
    "concept_prompt_file": "ignored", "reflect_prompt_file": "template of the prompt for explanations", "struct_min": "least structural overlap of a reported pair",
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="resemblage", description="Finds functions of like meaning, and shows the evidence.")
    analyze = top.add_subparsers(dest="command", required=True).add_parser("analyze")
    analyze.add_argument("path")
    for name, kind in config.KINDS.items():
        flags = [*([_SHORT[name]] if name in _SHORT else []), "--" + name.replace("_", "-")]
        analyze.add_argument(*flags, dest=name, type=kind, default=argparse.SUPPRESS, help=_HELP[name])
    return top


def main(args: list[str] | None = None, embedder=None, chat=None, spark=None) -> int:
    named = vars(parser().parse_args(args))
    named.pop("command")
    root = named.pop("path")
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(message)s")
    try:
        settings = config.settings(named, config.load(named.get("config") or config.FILE))
        found = analyse_tree(spark or local_session(), root, settings, embedder, chat)
        if found is None:
            print("No functions found.")
            return 0
        pairs, count = found
        print(report.text(pairs, settings.threshold, count), end="")
        if settings.output:
            report.write_markdown(settings.output, pairs, settings.threshold, count)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
