"""Rule tables.  Fixed values: they must equal those of the tool whose results are to be matched."""

from __future__ import annotations

EXT_TO_LANGUAGE = (
    (".ts", "TypeScript"), (".tsx", "TypeScript"), (".js", "JavaScript"), (".jsx", "JavaScript"), (".mjs", "JavaScript"), (".cjs", "JavaScript"), (".py", "Python"),
    (".go", "Go"), (".rs", "Rust"), (".java", "Java"), (".cs", "C#"), (".rb", "Ruby"), (".php", "PHP"), (".swift", "Swift"), (".dart", "Dart"), (".c", "C"), (".h", "C"),
    (".cpp", "C++"), (".cc", "C++"), (".cxx", "C++"), (".hpp", "C++"), (".kt", "Kotlin"), (".scala", "Scala"), (".ex", "Elixir"), (".exs", "Elixir"), (".zig", "Zig"),
    (".lua", "Lua"), (".r", "R"), (".pl", "Perl"), (".sh", "Shell"), (".bash", "Shell"), (".zsh", "Shell"), (".tcl", "Tcl"), (".fs", "F#"), (".fsx", "F#"), (".vb", "VB.NET"),
)
MANIFEST_CONFIRMS = (
    ("tsconfig.json", "TypeScript"), ("jsconfig.json", "JavaScript"), ("go.mod", "Go"), ("Cargo.toml", "Rust"), ("pyproject.toml", "Python"), ("setup.py", "Python"),
    ("requirements.txt", "Python"), ("Gemfile", "Ruby"), ("composer.json", "PHP"), ("pom.xml", "Java"), ("build.gradle", "Java"), ("build.gradle.kts", "Kotlin"),
    ("Package.swift", "Swift"), ("pubspec.yaml", "Dart"), ("mix.exs", "Elixir"), ("CMakeLists.txt", "C++"), ("build.zig", "Zig"),
)
EXT_MANIFEST_CONFIRMS = ((".csproj", "C#"), (".fsproj", "F#"))
NPM_FRAMEWORKS = (
    ("react", "React"), ("react-dom", "React"), ("next", "Next.js"), ("@remix-run/react", "Remix"), ("vue", "Vue"), ("nuxt", "Nuxt"), ("@angular/core", "Angular"),
    ("svelte", "Svelte"), ("@sveltejs/kit", "SvelteKit"), ("astro", "Astro"), ("solid-js", "SolidJS"), ("@nestjs/core", "NestJS"), ("express", "Express"),
    ("fastify", "Fastify"), ("hono", "Hono"), ("@hono/node-server", "Hono"), ("koa", "Koa"), ("electron", "Electron"), ("react-native", "React Native"), ("expo", "Expo"),
    ("@tauri-apps/api", "Tauri"), ("tailwindcss", "Tailwind CSS"), ("gatsby", "Gatsby"), ("@docusaurus/core", "Docusaurus"), ("storybook", "Storybook"),
    ("@storybook/react", "Storybook"), ("elysia", "Elysia"), ("@trpc/server", "tRPC"), ("@trpc/client", "tRPC"), ("@trpc/react-query", "tRPC"),
    ("@trpc/tanstack-react-query", "tRPC"), ("drizzle-orm", "Drizzle"), ("drizzle-kit", "Drizzle"), ("drizzle-zod", "Drizzle"), ("better-auth", "Better Auth"),
    ("@tanstack/react-query", "TanStack Query"), ("@tanstack/react-form", "TanStack Form"), ("@tanstack/react-router", "TanStack Router"), ("@tanstack/react-start", "TanStack Start"),
)
CONFIG_FRAMEWORKS = (
    ("next.config.js", "Next.js"), ("next.config.mjs", "Next.js"), ("next.config.ts", "Next.js"), ("nuxt.config.ts", "Nuxt"), ("nuxt.config.js", "Nuxt"),
    ("angular.json", "Angular"), ("svelte.config.js", "Svelte"), ("svelte.config.ts", "Svelte"), ("astro.config.mjs", "Astro"), ("astro.config.ts", "Astro"),
    ("tailwind.config.js", "Tailwind CSS"), ("tailwind.config.ts", "Tailwind CSS"), ("gatsby-config.js", "Gatsby"), ("gatsby-config.ts", "Gatsby"),
    ("remix.config.js", "Remix"), ("remix.config.ts", "Remix"), ("manage.py", "Django"),
)
PYTHON_FRAMEWORKS = (
    ("django", "Django"), ("flask", "Flask"), ("fastapi", "FastAPI"), ("starlette", "Starlette"), ("tornado", "Tornado"), ("celery", "Celery"), ("sqlalchemy", "SQLAlchemy"),
    ("pydantic", "Pydantic"), ("numpy", "NumPy"), ("pandas", "pandas"), ("tensorflow", "TensorFlow"), ("torch", "PyTorch"), ("scikit-learn", "scikit-learn"),
    ("werkzeug", "Werkzeug"), ("jinja2", "Jinja2"), ("markupsafe", "MarkupSafe"), ("blinker", "Blinker"), ("itsdangerous", "ItsDangerous"), ("click", "Click"),
    ("asgiref", "ASGI (asgiref)"), ("uvicorn", "Uvicorn"), ("gunicorn", "Gunicorn"),
)
GO_FRAMEWORKS = (
    ("github.com/gin-gonic/gin", "Gin"), ("github.com/gofiber/fiber", "Fiber"), ("github.com/labstack/echo", "Echo"), ("github.com/gorilla/mux", "Gorilla Mux"),
    ("github.com/go-chi/chi", "Chi"), ("google.golang.org/grpc", "gRPC"),
)
RUST_FRAMEWORKS = (("actix-web", "Actix Web"), ("axum", "Axum"), ("rocket", "Rocket"), ("warp", "Warp"), ("tonic", "Tonic"))
RUBY_FRAMEWORKS = (("rails", "Ruby on Rails"), ("sinatra", "Sinatra"), ("hanami", "Hanami"))
ELIXIR_FRAMEWORKS = ((":phoenix", "Phoenix"), (":phoenix_live_view", "Phoenix LiveView"), (":absinthe", "Absinthe"), (":nerves", "Nerves"))
DOTNET_FRAMEWORKS = (
    ("Microsoft.AspNetCore", "ASP.NET Core"), ("Microsoft.NET.Sdk.Web", "ASP.NET Core"), ("Microsoft.AspNetCore.Components", "Blazor"),
    ("Microsoft.AspNetCore.SignalR", "SignalR"), ("Microsoft.Maui", "MAUI"),
)
JVM_FRAMEWORKS = (
    ("org.springframework.boot", "Spring Boot"), ("spring-boot-starter", "Spring Boot"), ("org.springframework", "Spring"), ("io.micronaut", "Micronaut"),
    ("io.quarkus", "Quarkus"), ("io.dropwizard", "Dropwizard"), ("io.vertx", "Vert.x"), ("io.ktor", "Ktor"), ("org.hibernate", "Hibernate"),
)
PHP_FRAMEWORKS = (
    ("laravel/framework", "Laravel"), ("symfony/framework-bundle", "Symfony"), ("symfony/http-kernel", "Symfony"), ("slim/slim", "Slim"), ("cakephp/cakephp", "CakePHP"),
    ("yiisoft/yii2", "Yii"), ("codeigniter4/framework", "CodeIgniter"),
)
SCALA_FRAMEWORKS = (("com.typesafe.play", "Play Framework"), ("com.typesafe.akka", "Akka"), ("org.http4s", "http4s"), ("dev.zio", "ZIO"))
LOCKFILES = (
    ("package-lock.json", "npm"), ("npm-shrinkwrap.json", "npm"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "Yarn"), ("bun.lock", "Bun"), ("bun.lockb", "Bun"),
    ("Pipfile.lock", "Pipenv"), ("poetry.lock", "Poetry"), ("uv.lock", "uv"), ("Cargo.lock", "Cargo"), ("go.sum", "Go modules"), ("Gemfile.lock", "Bundler"),
    ("composer.lock", "Composer"), ("packages.lock.json", "NuGet"), ("pubspec.lock", "pub"), ("gradle.lockfile", "Gradle"), ("mix.lock", "Mix"),
    ("stack.yaml.lock", "Stack"), ("cabal.project.freeze", "Cabal"), ("Package.resolved", "Swift Package Manager"),
)
POETRY_RE, UV_RE, PIPENV_RE = r"\[tool\.poetry\]", r"\[tool\.uv(?:\.[a-zA-Z][a-zA-Z0-9_-]*)?\]", r"\[tool\.pipenv\]"
MANIFESTS = (
    ("pyproject.toml", POETRY_RE, "Poetry"), ("pyproject.toml", UV_RE, "uv"), ("pyproject.toml", PIPENV_RE, "Pipenv"), ("Pipfile", None, "Pipenv"),
    ("pnpm-workspace.yaml", None, "pnpm"), ("Cargo.toml", None, "Cargo"), ("go.mod", None, "Go modules"), ("pubspec.yaml", None, "pub"), ("Gemfile", None, "Bundler"),
    ("composer.json", None, "Composer"), ("pom.xml", None, "Maven"), ("build.gradle", None, "Gradle"), ("build.gradle.kts", None, "Gradle"), ("build.sbt", None, "sbt"),
    ("mix.exs", None, "Mix"), ("stack.yaml", None, "Stack"), ("cabal.project", None, "Cabal"), ("Package.swift", None, "Swift Package Manager"), ("packages.config", None, "NuGet"),
)
MANIFEST_EXTENSIONS = ((".cabal", "Cabal"), (".csproj", "NuGet"), (".fsproj", "NuGet"), (".vbproj", "NuGet"))
PACKAGE_MANAGER_FIELD = (("npm", "npm"), ("pnpm", "pnpm"), ("yarn", "Yarn"), ("bun", "Bun"))
PYTHON_SIGNAL_FILES = ("uv.lock", "poetry.lock", "Pipfile.lock", "Pipfile")
BUILD_FILES = (
    ("Makefile", "Make"), ("makefile", "Make"), ("GNUmakefile", "Make"), ("Justfile", "Just"), ("justfile", "Just"), (".justfile", "Just"), ("Taskfile.yml", "Task"),
    ("Taskfile.yaml", "Task"), ("taskfile.yml", "Task"), ("taskfile.yaml", "Task"), ("Taskfile.dist.yml", "Task"), ("Taskfile.dist.yaml", "Task"),
    ("taskfile.dist.yml", "Task"), ("taskfile.dist.yaml", "Task"), ("Rakefile", "Rake"), ("rakefile", "Rake"), ("CMakeLists.txt", "CMake"), ("meson.build", "Meson"),
    ("SConstruct", "SCons"), ("Sconstruct", "SCons"), ("sconstruct", "SCons"), ("SConstruct.py", "SCons"), ("sconstruct.py", "SCons"), ("SConscript", "SCons"),
    ("build.xml", "Ant"), ("BUILD.bazel", "Bazel"), ("WORKSPACE", "Bazel"), ("WORKSPACE.bazel", "Bazel"), ("MODULE.bazel", "Bazel"), ("BUILD.gn", "GN"), (".gn", "GN"),
    ("magefile.go", "Mage"), ("mage.go", "Mage"), ("Earthfile", "Earthly"), ("dagger.json", "Dagger"), ("build.zig", "Zig build"),
)
CI_FILES = (
    (".gitlab-ci.yml", "GitLab CI"), (".travis.yml", "Travis CI"), ("Jenkinsfile", "Jenkins"), ("azure-pipelines.yml", "Azure Pipelines"),
    ("bitbucket-pipelines.yml", "Bitbucket Pipelines"), ("appveyor.yml", "AppVeyor"), (".appveyor.yml", "AppVeyor"), (".drone.yml", "Drone CI"),
    ("cloudbuild.yaml", "Google Cloud Build"), ("cloudbuild.yml", "Google Cloud Build"), ("codemagic.yaml", "Codemagic"), ("bitrise.yml", "Bitrise"),
)
CI_FOLDERS = ((".github/workflows", "GitHub Actions"), (".buildkite", "Buildkite"), (".teamcity", "TeamCity"), (".semaphore", "Semaphore"), (".circleci", "CircleCI"))
CONTAINER_FILES = (
    ("Dockerfile", "Docker"), ("Containerfile", "Podman"), ("docker-compose.yml", "Docker Compose"), ("docker-compose.yaml", "Docker Compose"),
    ("compose.yml", "Docker Compose"), ("compose.yaml", "Docker Compose"), (".devcontainer.json", "Dev Container"), ("devcontainer.json", "Dev Container"),
)
CONTAINER_FOLDERS: tuple[tuple[str, str], ...] = ()
SINGLE_VERSION_FILES = (
    (".nvmrc", "Node"), (".node-version", "Node"), (".python-version", "Python"), (".ruby-version", "Ruby"), (".terraform-version", "Terraform"), (".crystal-version", "Crystal"),
)
ENGINES = (("node", "Node"), ("npm", "npm"), ("pnpm", "pnpm"), ("yarn", "Yarn"), ("bun", "Bun"))
TOOL_ALIASES = (
    ("nodejs", "Node"), ("node", "Node"), ("python", "Python"), ("ruby", "Ruby"), ("rust", "Rust"), ("golang", "Go"), ("go", "Go"), ("terraform", "Terraform"),
    ("bun", "Bun"), ("deno", "Deno"), ("elixir", "Elixir"), ("erlang", "Erlang"), ("java", "Java"), ("kotlin", "Kotlin"), ("swift", "Swift"),
)
MONOREPO_MARKERS = (
    ("turbo.json", "Turborepo"), ("nx.json", "Nx"), ("lerna.json", "Lerna"), ("rush.json", "Rush"), ("pnpm-workspace.yaml", "pnpm workspaces"), ("go.work", "Go workspaces"),
    ("melos.yaml", "Melos (Dart)"), ("pants.toml", "Pants"), ("WORKSPACE", "Bazel"), ("WORKSPACE.bazel", "Bazel"), ("MODULE.bazel", "Bazel"),
)
MONOREPO_EXTENSIONS = ((".sln", ".NET Solution"),)
CONVENTION_FOLDERS = (
    "apps", "app", "services", "service", "packages", "libs", "lib", "modules", "infra", "infrastructure", "terraform", "deploy", "tools", "tooling", "scripts", "e2e", "crates", "python",
)
COMPONENT_MANIFESTS = (
    "package.json", "Cargo.toml", "go.mod", "pyproject.toml", "pubspec.yaml", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile", "composer.json",
)
COMPONENT_EXTENSIONS = (".csproj", ".fsproj", ".vbproj")
IGNORED_FOLDERS = (
    "node_modules", "vendor", ".git", "dist", "build", "target", "__pycache__", ".tox", ".venv", "venv", ".mypy_cache", ".gradle", "bin", "obj", ".dart_tool", ".pub-cache",
    "Pods", ".next", ".nuxt", ".output", "coverage", ".turbo", "deps",
)
KEPT_DOT_FOLDERS = (
    ".github", ".circleci", ".husky", ".changeset", ".buildkite", ".vscode", ".azure", ".semgrep", ".checkmarx", ".do", ".ebextensions", ".teamcity", ".semaphore", ".devcontainer",
)
SECONDARY_FOLDERS = (
    "examples", "example", "test", "tests", "testdata", "test-data", "__tests__", "__fixtures__", "fixtures", "playground", "playgrounds", "samples", "sample", "benchmarks",
    "benchmark", "demo", "demos", "truth", "__testfixtures__", "compiled",
)
KINDS = ("app", "service", "package", "library", "infra", "script")
KIND_BY_PATH = (
    (r"^(?:apps|app)(?:/|$)", "app"), (r"^(?:services|service)(?:/|$)", "service"), (r"^(?:packages|libs|pkg)(?:/|$)", "package"), (r"^crates(?:/|$)", "library"),
    (r"^(?:infra|terraform|deploy|pulumi|cdk)(?:/|$)", "infra"), (r"^(?:scripts|tools|tooling)(?:/|$)", "script"), (r"^(?:e2e|test|tests|__tests__)(?:/|$)", "script"),
)
APP_FILES = ("index.html", "vercel.json", "netlify.toml", "fly.toml", "render.yaml", "app.yaml", "angular.json")
APP_PREFIXES = ("vite.config", "next.config", "nuxt.config", "webpack.config", "svelte.config", "remix.config", "astro.config")
SERVICE_FILES = ("Dockerfile", "nest-cli.json", "nodemon.json", "server.ts", "server.js", "app.ts", "app.js")
PACKAGE_PREFIXES = ("tsup.config", "rollup.config")
MAX_TEXT_BYTES = 5 * 1024 * 1024
MAX_DEPTH = 50
DETECTORS = (
    ("framework", "Framework and library detection"), ("language", "Language and LOC detection"), ("monorepo", "Monorepo structure and components"),
    ("packageManager", "Package manager detection from lockfiles and manifests"), ("ciProvider", "CI/CD provider detection from config files"),
    ("buildSystem", "Build system orchestration detection"), ("containerization", "Container runtime and orchestration detection"),
    ("runtime", "Runtime version detection from project config"),
)
# Patterns that texts are read by.  Fixed values as well.
GO_VERSION_RE = r"(?m)^go\s+([0-9.]+)"
GEMFILE_RUBY_RE = r"""(?m)^\s*ruby\s+['"]([^'"]+)['"]"""
REQUIRES_PYTHON_RE = r'(?m)^\s*requires-python\s*=\s*"([^"]+)"'
RUST_VERSION_RE = r'(?m)^\s*rust-version\s*=\s*"([^"]+)"'
MISE_TOOL_RE = r'(?m)^\s*([A-Za-z0-9_-]+)\s*=\s*"([^"]+)"'
TOOL_COMMENT_RE = r"#[^\r\n]*\z"
SLN_PROJECT_RE = r'Project\("[^"]*"\)\s*=\s*"([^"]+)"\s*,\s*"([^"]+\.(?:csproj|fsproj|vbproj))"'
PNPM_COMMENT_RE = r"#[^\r\n]*\z"
PNPM_OPEN_RE, PNPM_ITEM_RE, PNPM_END_RE = r"^\s*packages\s*:", r"""^\s*-\s*['"]?([^'"\s]+)['"]?\s*$""", r"^\S"
GO_USE_BLOCK_RE, GO_USE_LINE_RE, GO_COMMENT_RE = r"use\s*\(([^)]*)\)", r"^use\s+(\S+)$", r"//[^\r\n]*\z"
SBT_PROJECT_RE = r"lazy\s+val\s+\w+\s*=\s*\(?project"
GRADLE_INCLUDE_RE, GRADLE_MODULE_RE = r"include\s*\(?([^)\n]+)\)?", r"""['"](:?[^'"]+)['"]"""
MAVEN_MODULE_RE = r"<module>([^<]+)</module>"
UV_MEMBERS_RE, QUOTED_RE = r"(?s)\[tool\.uv\.workspace\][^\[]*members\s*=\s*\[([^\]]*)\]", r"""["']([^"']+)["']"""
