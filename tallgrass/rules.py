"""What is scanned, what is left out, and what counts as built in."""

# Lists that results depend on, in their natural order.

EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]

#: Tools whose `<tool>.config.(js|ts|mjs|cjs)` belongs to production; `next-<anything>.config.*` does too.
PRODUCTION_TOOLS = ["next", "next-[^/]+", "webpack", "vite", "rollup", "postcss", "tailwind", "esbuild"]

DEV_CONFIGS = ["jest.config.", "vitest.config.", "babel.config.", "eslint.config.", "prettier.config.", "tsup.config.", "biome.config."]

EXCLUDED_DIRECTORIES = ["node_modules/", "dist/", "build/", "out/", "/test/", "/tests/", "/__tests__/", "/__mocks__/", "/stories/", "/.storybook/", "/coverage/", "/e2e/", "/cypress/", "/playwright/"]

EXCLUDED_NAMES = [".test.", ".spec.", ".stories.", ".story.", "testing-library.", "test-utils.", "setupTests.", "jest.setup.", "vitest.setup.", "happydom.", "happy-dom.", "setup-tests.", "test-setup."]

BUILD_OUTPUT = [
    "dist/**", "build/**", "out/**", ".next/**", ".nuxt/**", ".output/**", ".vite/**", "storybook-static/**", ".storybook-static/**",
    ".cache/**", "public/**", ".docusaurus/**", ".vitepress/dist/**", ".vitepress/cache/**", ".astro/**", ".svelte-kit/**", ".remix/**",
    ".webpack/**", ".parcel-cache/**", ".turbo/**", "tmp/**", "temp/**", ".tmp/**", ".temp/**", "coverage/**", ".coverage/**",
]

CACHES = ["node_modules/**", ".cache/**", ".npm/**", ".yarn/**", ".pnpm/**", ".bun/**", ".eslintcache", ".stylelintcache", "**/.DS_Store"]

EDITORS = [".vscode/**", ".idea/**", ".fleet/**", ".vim/**", ".emacs.d/**"]

TESTS = ["**/test/**", "**/tests/**", "**/__tests__/**", "**/__mocks__/**", "**/*.test.*", "**/*.spec.*", "**/setupTests.*", "**/jest.setup.*", "**/vitest.setup.*"]

STORIES = ["**/stories/**", "**/.storybook/**", "**/*.stories.*", "**/*.story.*"]

BUILD_SUFFIXES = ["-static", "-dist", "-build", "-output"]

NODE_BUILTINS = [
    "fs", "path", "http", "https", "util", "events", "stream", "crypto", "os", "child_process", "url", "querystring", "buffer", "process",
    "assert", "zlib", "net", "tls", "dns", "dgram", "cluster", "vm", "v8", "timers", "readline", "repl", "module",
]

BUN_BUILTINS = ["bun", "bun:test", "bun:sqlite", "bun:ffi", "bun:jsc"]

# End of the fixed values.

BUILTINS = NODE_BUILTINS + [f"node:{x}" for x in NODE_BUILTINS] + BUN_BUILTINS

#: Globs that are left out of every scan, each once.
STATIC_GLOBS = list(dict.fromkeys(BUILD_OUTPUT + CACHES + EDITORS + TESTS + STORIES + ["**/*.d.ts"]))

RUNTIME, TYPE_ONLY = "runtime", "type-only"
DEPENDENCIES, DEV, PEER = "dependencies", "devDependencies", "peerDependencies"
SECTIONS = [DEPENDENCIES, DEV, PEER]

#: What counts as white space in the scanned languages, as a Java or Python character class without brackets.
WHITE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
