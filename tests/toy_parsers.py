"""Parsers of two languages for tests: a unit for each line."""

import re


def lines(path, source):
    for k, line in enumerate(source.decode().splitlines(), 1):
        found = re.match(r"(?:pub )?(fn|mod|export)\b\s*(\w*)", line)
        if found:
            kind = "function" if found[1] == "fn" else "module"
            node = {"fn": "function_item", "mod": "mod_item", "export": "export_statement"}[found[1]]
            yield {"id": f"{path}:{found[2] or k}", "kind": kind, "name": found[2] or str(k), "path": path, "signature": line, "code": line, "code_hash": "h", "metadata": f'{{"start_line": {k}, "node_type": "{node}"}}'}


PARSERS = {"rust": lines, "javascript": lines}
