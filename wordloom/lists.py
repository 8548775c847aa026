"""Word lists and tables of the spelling and terminology checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Very common English words, which win ties between suggestions.
COMMON_WORDS = """
the be to of and a in that have it for not on with he as you do at this but his by from
they we say her she or an will my one all would there their what so up out if about who
get which go me when make can like time no just him know take people into year your good
some could them see other than then now look only come its over think also back after use
two how our work first well way even new want because any these give day most us is was
are been has had were said did having may should each such where much before right too
old same tell does set three must state never become between high really something
receive separate exist success occurred definitely word words world spelling account
tomorrow calendar guarantee maintenance problem system program different important
information government development experience community business service research
""".split()

# Technical words that are valid whatever the lexicon says.
TECH_WORDS = """
app apps api apis arg args aspell auth bool bugfix changelog charset checksum
chmod cli cmdline codebase codespell config configs cookie cors cpu cron crud
csv cspell cwd datetime dbg desc dev diff dir dns docstring docs dotfile
dotfiles dotenv dup endpoint endpoints enum enums env errno filepath filetype
frontend git github gitlab glob graphql gui gzip hexdump homebrew hostname
hotfix http https hunspell idx impl infra ini ispell jpeg jpg js json jsx kebab
localhost lockfile lsp markdown mjs middleware monorepo msg multiline myspell
namespace nodejs npm nullable nspell oauth param params png polyfill popup
prepublish pubsub py pyproject readme regex regexes refactor refactored repo
repos retarget roadmap rollback runtime scaffold scrollbar sdk serde shebang
sidebar sqlite stacktrace stdin stdout stderr subdir subcommand
subdirectory svg symlink tcp tls tmp todo todos tokenizer toolchain tooltip
transpile transpiled transpiler tsconfig tsx txt typescript utf utf8 uuid vcs
vscode webpack websocket wifi wildcard workflow workflows xml yaml yml zlib
zsh
js ts jsx tsx mjs cjs py rb rs go sh md html css sql php kt swift toml tsv
""".split()

# Brand and technical terms in the casing to recommend.
BRANDS = """
GitHub GitLab Bitbucket JavaScript TypeScript Node.js
Next.js Vue.js npm iOS iPadOS macOS MySQL PostgreSQL
SQLite MongoDB GraphQL WebSocket WebAssembly OpenAI
ChatGPT YouTube LinkedIn DevOps Kubernetes Nginx Linux
Unix Unicode ASCII UTF-8 API CLI GUI UI UX
HTTP HTTPS JSON YAML XML TOML SQL NoSQL CSS
HTML URL URI UUID CRUD SDK DNS TCP UDP SSH
TLS SSL VPN CDN CPU GPU RAM SSD AI ML LLM
GPT RAG AWS GCP SaaS OAuth JWT REST XSS CSRF
CORS FAQ CI IP
""".split()

# Directories, manifests and source extensions of a repository harvest. "jsx" has no dot.
SKIP_DIRS = "node_modules dist build out coverage vendor target __pycache__ venv env site-packages bower_components .terraform examples fixtures".split()
MANIFESTS = "package.json cargo.toml go.mod pyproject.toml requirements.txt".split()
SOURCE_EXTENSIONS = ".ts .tsx .js jsx .mjs .cjs .py .go .rs .java .kt .rb .php .c .h .cpp .hpp .cs .swift .sh .md .markdown .mdx .txt .yml .yaml .toml .json".split()
MAX_FILE_BYTES = 512 * 1024
#: Files of a project that are looked at unless the caller says otherwise.
MAX_FILES = 1500


def words_table(spark: SparkSession, words: list[str]) -> DataFrame:
    """(word): a small list as a table."""
    return spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")


def brands_table(spark: SparkSession) -> DataFrame:
    """(key, display, alpha): the comparison key is the lower-cased alphanumeric projection."""
    alphas = {b: "".join(c for c in b if c.isascii() and c.isalnum()) for b in BRANDS}
    return spark.createDataFrame([(a.lower(), b, a) for b, a in alphas.items()], "key string, display string, alpha string")
