"""A small repository with fixed dates that covers what the readers must handle."""

import os
import subprocess
from pathlib import Path

BODY = "".join(f"line number {i} of the file\n" for i in range(40))


class Repo:
    def __init__(self, path: Path):
        self.path = path
        self.when = 1_700_000_000
        path.mkdir(parents=True)
        self.git("init", "-q", "-b", "main", ".")
        self.git("config", "commit.gpgsign", "false")

    def git(self, *args, who=("Ann Lee", "ann@x.example"), check=True):
        env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who[0]), ("EMAIL", who[1]), ("DATE", f"{self.when} +0200"))}
        return subprocess.run(["git", "-C", str(self.path), *args], env=env, check=check, capture_output=True, text=True).stdout

    def write(self, name, data):
        p = self.path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    def commit(self, message, who=("Ann Lee", "ann@x.example"), days=1):
        self.when += days * 86400
        self.git("add", "-A")
        self.git("commit", "-q", "--allow-empty", "-m", message, who=who)
        return self.git("rev-parse", "HEAD").strip()


def build(path: Path) -> Repo:
    r = Repo(path)
    r.write("src/a.txt", BODY)
    r.write("noeol.txt", "one\ntwo")
    r.write("crlf.txt", "a\r\nb\r\n")
    r.write("empty.txt", "")
    r.write("bin.dat", b"x\0y")
    r.write("yarn.lock", "lock\n")
    r.write("vendor/v.c", "int v;\n")
    r.write("gen.py", "# Code generated by tool\nx = 1\n")
    r.write("package.json", '{"dependencies": {"left": "^1.0"}, "devDependencies": {"right": "2"}}')
    r.write("lib/util.py", "def helper():\n    # TODO: tidy\n    return 1\n\n\nclass Box:\n    def get(self):\n        return helper()\n")
    r.write("lib/test_util.py", "from lib.util import helper\n\n\ndef test_helper():\n    assert helper() == 1\n")
    r.write("web/index.ts", "export { add as plus } from './math';\nexport * from './more';\n")
    r.write("web/math.ts", "export function add(a: number) {\n  return a;\n}\n")
    r.write("web/more.ts", "export const twice = (x: number) => x + x;\n")
    r.write("web/app.ts", "import { plus, twice } from '.';\nimport { far } from 'ext';\nfunction far2() {}\nexport function main() {\n  plus(1);\n  twice(2);\n  far();\n  far2();\n}\n")
    r.write("web/tsconfig.json", '{ // the site\n  "compilerOptions": { "baseUrl": ".", /* aliases */ "paths": { "@m/*": ["./nowhere/*", "./*"], "@sums": ["./math"], }, },\n}\n')
    r.write("web/deep/use.ts", "import { add } from '@sums';\nimport { twice } from '@m/more';\nimport { gone } from '@n/more';\nexport function both() {\n  add(1);\n  twice(2);\n  gone();\n}\n")
    r.commit("feat(core)!: start")
    r.git("tag", "light")
    r.write("src/b.txt", BODY.replace("line number 7 ", "changed 7 "))
    (r.path / "src/a.txt").unlink()
    r.commit("move a to b\n\nMore words.\n\nSigned-off-by: Ann\nFixes #3", who=("Ann Lee", "5+annlee@users.noreply.github.com"))
    r.git("mv", "noeol.txt", "kept.txt")
    os.chmod(r.path / "crlf.txt", 0o755)
    os.symlink("kept.txt", r.path / "link")
    r.commit("fix: rename exactly", who=("Bob", "bob@x.example"))
    r.git("tag", "-a", "v1", "-m", "First\n\nTag body")
    r.git("checkout", "-q", "-b", "side")
    r.write("src/side.txt", "side\n")
    r.commit("Added side", who=("Bob", "bob@y.example"))
    r.git("checkout", "-q", "main")
    r.write("crlf.txt", "a\r\nb\r\nc\r\n")
    r.commit("docs: more")
    r.when += 86400
    r.git("merge", "-q", "--no-ff", "--no-commit", "side")
    r.write("yarn.lock", "lock\nevil\n")
    r.git("add", "-A")
    r.git("commit", "-q", "-m", "Merge side")
    r.git("notes", "add", "-m", "a note", "HEAD~1")
    r.git("branch", "old", "HEAD~3")
    r.git("update-index", "--add", "--cacheinfo", f"160000,{'1' * 40},sub/mod")
    r.write(".gitmodules", '[submodule "m"]\n\tpath = sub/mod\n\turl = https://x.example/m\n')
    r.git("add", ".gitmodules")
    r.when += 86400
    r.git("commit", "-q", "-m", "add submodule")
    return r


def later(r: Repo) -> None:
    """Two more commits, for updates."""
    r.write("src/b.txt", (r.path / "src/b.txt").read_text() + "tail\n")
    r.write("lib/new.py", "from lib.util import Box\n\n\ndef use():\n    return Box().get()\n")
    r.commit("feat: more", who=("Robert", "bob@x.example"))
    (r.path / "kept.txt").unlink()
    r.commit("drop kept", days=100)
