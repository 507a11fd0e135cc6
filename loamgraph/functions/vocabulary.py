"""Fixed values that results depend on: word lists, weights and factors.  They are data, not logic."""

# Literal search stop terms.
LITERAL_STOP = ["architecture", "configuration", "contracts", "documentation", "docs", "feature", "guide", "implementation", "infrastructure", "readme", "services", "source", "story", "tests", "user", "workflow"]
# Words a question is not routed by.
ROUTE_STOP = ["and", "api", "app", "apps", "are", "can", "does", "for", "from", "has", "hood", "how", "into", "its", "lib", "src", "that", "the", "this", "under", "was", "web", "what", "when", "where", "which", "who", "why", "with", "work", "works", "you", "your"]
# Words left out of lexical area matching.
LEXICAL_STOP = ["and", "the", "for", "with", "from", "into", "that", "this", "are", "was", "has", "you", "our", "its", "all", "any", "how", "via", "per", "out", "use"]
# Words left out of a task.
TASK_STOP = ["and", "are", "for", "from", "how", "into", "the", "this", "that", "then", "with", "would", "should", "could", "feature", "implement", "implementation", "store"]
# Words that make a question one about dependencies or deployment.
DEPENDENCY_WORDS = ["dependency", "dependencies", "package", "library", "sdk", "version", "npm", "crate"]
DEPLOYMENT_WORDS = ["deploy", "deployment", "infrastructure", "stack", "cdk", "terraform", "kubernetes", "configured", "configuration"]
# Words that mark a change as a bug.
BUG_WORDS = ["fix", "bug", "hotfix", "patch", "regression", "revert", "issue", "defect"]
# Path segments of each layer, in order of precedence.
PATH_LAYERS = [
    ("core", ["repositories", "repository", "services", "service", "domain", "usecases", "use-cases", "business", "logic", "models"]),
    ("interface", ["api", "resolvers", "resolver", "controllers", "controller", "handlers", "handler", "routes", "graphql", "endpoints"]),
    ("entry", ["apps", "app", "client", "clients", "frontend", "ui", "web", "cli", "cmd", "bin", "pages", "screens", "views"]),
    ("foundation", ["contracts", "contract", "infra", "infrastructure", "cdk", "terraform", "stacks", "stack", "deploy", "deployment", "config", "types", "constants", "abi", "abis"]),
]
# Words that name a layer.
WORD_LAYERS = {
    "entry": ["entry", "client", "clients", "ui", "frontend", "web", "webapp", "app", "apps", "cli", "cmd", "page", "pages", "screen", "screens", "view", "views", "portal", "dashboard", "console"],
    "interface": ["interface", "api", "apis", "resolver", "resolvers", "controller", "controllers", "handler", "handlers", "route", "routes", "endpoint", "endpoints", "graphql", "rest", "gateway"],
    "core": ["core", "service", "services", "logic", "business", "domain", "repository", "repositories", "usecase", "usecases", "model", "models"],
    "foundation": ["foundation", "contract", "contracts", "infra", "infrastructure", "config", "types", "constants", "abi", "abis", "terraform", "cdk", "stack", "stacks", "deploy", "deployment", "onchain", "solidity", "sol"],
}
# Rank of the layers from the outside in.
LAYER_RANK = {"entry": 0, "interface": 1, "core": 2, "unknown": 3, "foundation": 4}
# Services of infrastructure constructs; the first word found decides.
CONSTRUCT_SERVICES = [("lambda", ["lambda", "function"]), ("dynamodb", ["dynamodb", "table"]), ("appsync", ["appsync", "graphql"]), ("s3", ["s3", "bucket"]), ("cloudfront", ["cloudfront", "distribution"]), ("sqs", ["sqs", "queue"]), ("sns", ["sns", "topic"]), ("iam", ["iam", "role", "policy"]), ("api_gateway", ["apigateway", "api"]), ("eventbridge", ["event", "rule"])]
# Traversal cost and confidence of edges, by what they say.
EDGE_WEIGHTS = {
    "contains_code": (0.10, 1.0),
    "contains_member": (0.10, 1.0),
    "contains_doc": (0.45, 0.80),
    "contains_pdf": (0.55, 0.75),
    "depends_on": (0.20, 1.0),
    "defines_script": (0.25, 1.0),
    "defines": (0.08, 1.0),
    "configures": (0.12, 0.95),
    "configures_app": (0.15, 1.0),
    "imports_rust": (0.40, 0.80),
    "imports_module": (0.35, 1.0),
    "imports_solidity": (0.30, 1.0),
    "calls": (0.35, 0.70),
    "implements": (0.20, 0.95),
}
# Endings of static files, which are no routes.
STATIC_ENDINGS = ["js", "mjs", "cjs", "css", "map", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "woff", "woff2", "ttf", "html", "json", "txt", "xml", "pdf"]
# Commands that change a repository.
MUTATING_COMMANDS = ["git commit", "git merge", "git pull", "git checkout"]
# Confidence of links between repositories.
LINK_CONFIDENCE = {"package_dep": 0.9, "abi": 0.8, "http_route": 0.65}
# Markers of registered and of called routes.
ROUTE_MARKERS = ["app.get(", "app.post(", "app.put(", "app.patch(", "app.delete(", "app.all(", "app.use(", "router.get(", "router.post(", "router.put(", "router.patch(", "router.delete(", "router.all(", "fastify.get(", "fastify.post(", "fastify.put(", "fastify.delete(", ".route(", "@get(", "@post(", "@put(", "@patch(", "@delete(", "@controller(", "#[get(", "#[post(", "#[put(", "#[patch(", "#[delete("]
CALL_MARKERS = ["fetch(", "axios(", "axios.get(", "axios.post(", "axios.put(", "axios.patch(", "axios.delete(", "axios.request(", "useswr(", ".get(", ".post(", ".put(", ".patch(", ".delete(", "ky.get(", "ky.post(", "got("]
# Name space of derived ids.
ID_NAMESPACE = "9e4f1a77-2c38-4b6d-a10c-5e823f91d46a"
