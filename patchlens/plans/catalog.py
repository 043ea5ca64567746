"""Dimensions of the review: rules, roles, bands, clusters, wording."""

from __future__ import annotations

# Rule id -> severity, weight. Two rules have the default weight of 5.
RULES = {
    "secret-pattern": ("high", 34), "code-exec": ("high", 32), "timing-compare": ("high", 30), "workflow-permissions": ("high", 28),
    "privileged-trigger": ("high", 5), "deleted-tests": ("high", 26), "migration": ("high", 24), "sensitive-surface": ("medium", 14),
    "missing-tests": ("medium", 12), "html-sink": ("medium", 12), "dependency-manifest": ("medium", 10), "runtime-config": ("medium", 9),
    "api-change": ("medium", 8), "large-file": ("medium", 8), "over-budget": ("medium", 10), "lockfile": ("medium", 5),
    "ci-publish": ("medium", 5), "ci-changed": ("low", 4), "binary-file": ("low", 3), "whitespace-only": ("info", 1), "generated-file": ("info", 1),
}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}

# Role -> band, in order of priority.
BANDS = {
    "test": 70, "lockfile": 90, "generated": 90, "asset": 90, "docs": 80, "migration": 20, "ci": 20, "deps": 30,
    "auth": 20, "crypto": 20, "payment": 20, "api": 10, "types": 10, "schema": 10, "config": 40, "source": 50,
}
# Roles that are clusters of their own, and file names that decide a role.
CLUSTER_ROLES = ["test", "docs", "ci", "lockfile", "migration", "deps", "generated", "asset", "config"]
LOCKFILES = ["package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "poetry.lock", "pipfile.lock", "composer.lock", "gemfile.lock", "go.sum", "bun.lock", "uv.lock"]
MANIFESTS = ["package.json", "pyproject.toml", "requirements.txt", "go.mod", "cargo.toml", "gemfile", "composer.json", "pom.xml", "build.gradle", "build.gradle.kts"]

# Patterns of the paths that decide a role, and words that do as a part of a path.
TEST_PATHS = [r"\.(?:test|spec)\.[cm]?[jt]sx?$", r"(?:^|\/)__tests__\/", r"(?:^|\/)tests?\/", r"_test\.go$", r"(?:^|\/)test_[^/]*\.py$", r"Test\.java$"]
ROLE_PATHS = {
    "generated": [r"(?:^|\/)(?:dist|generated|vendor|__generated__)\/", r"\.min\.js$", r"\.pb\.go$"],
    "asset": [r"\.(?:png|jpe?g|gif|webp|svg|ico|woff2?|ttf|eot|mp4|pdf)$"],
    "docs": [r"\.(?:md|mdx|rst|adoc)$"],
    "docs folder": [r"(?:^|\/)(?:docs?|examples?|samples?)\/"],
    "migration": ["migrat(?:e|ion|ions)", r"alembic|flyway|prisma\/migrations"],
    "migration sql": [r"migrat|\/db\/|schema"],
    "ci": [r"jenkinsfile|\.gitlab-ci|azure-pipelines|\.circleci"],
    "ci folder": [r"(?:^|\/)\.(?:gitlab\/ci|buildkite|woodpecker)\/", r"(?:^|\/)(?:bitbucket-pipelines|\.travis|\.drone|\.woodpecker|\.?appveyor)\.ya?ml$"],
    "api": [r"(?:^|\/)(?:api|routes|handlers|controllers)\/", r"\/index\.[cm]?[jt]s$"],
    "types": [r"\.d\.ts$", r"(?:^|\/)types?\/"],
    "schema": [r"schema\.prisma$|\.proto$|schema\.graphql|openapi\.(?:ya?ml|json)$|(?:^|\/)schemas?\/"],
    "config": [r"(?:^|\/)Dockerfile(?:\.[^/]+)?$", r"(?:^|\/)docker-compose[^/]*\.ya?ml$", r"(?:^|\/)(?:k8s|helm|charts|deploy)\/"],
}
PATH_WORDS = {
    "auth": "auth|authentication|session|sessions|oauth|jwt|rbac|permissions|permission|secrets",
    "crypto": "crypto|cipher|kms|webhooks?|signing|hmac|signatures?",
    "payment": "billing|payments?|checkout|invoices?|stripe",
}

#: Our own wording from here on, always (English, Portuguese).
#: A rule's title in a finding, and its detail; {} in a detail is what was found.
TITLES = {
    "secret-pattern": ("Looks like a credential", "Parece uma credencial"),
    "code-exec": ("Runs code built at run time", "Executa código montado em tempo de execução"),
    "timing-compare": ("Digest compared without constant time", "Digest comparado sem tempo constante"),
    "workflow-permissions": ("Automation may write", "Automação pode escrever"),
    "privileged-trigger": ("Automation starts with secrets at hand", "Automação inicia com segredos"),
    "deleted-tests": ("Test removed", "Teste removido"),
    "migration": ("Database structure changes", "Estrutura do banco muda"),
    "sensitive-surface": ("Sensitive code path: {}", "Caminho sensível: {}"),
    "missing-tests": ("No test goes with this change", "Nenhum teste acompanha a mudança"),
    "html-sink": ("Raw HTML from data", "HTML cru vindo de dados"),
    "dependency-manifest": ("Dependencies change", "Dependências mudam"),
    "runtime-config": ("Runtime set-up changes", "Configuração de execução muda"),
    "api-change": ("Public interface changes", "Interface pública muda"),
    "large-file": ("Large share of the diff", "Parte grande do diff"),
    "over-budget": ("More than the time budget", "Acima do orçamento de tempo"),
    "lockfile": ("Resolved versions change", "Versões resolvidas mudam"),
    "ci-publish": ("Automation publishes", "Automação publica"),
    "ci-changed": ("Automation changes", "Automação muda"),
    "binary-file": ("Binary content", "Conteúdo binário"),
    "whitespace-only": ("Only white space", "Só espaço em branco"),
    "generated-file": ("Generated content", "Conteúdo gerado"),
}
DETAILS = {
    "secret-pattern": ("Found: {}. Revoke it if it works; use an evident dummy if it is test data.", "Encontrado: {}. Revogue se funciona; use um valor claramente fictício se for dado de teste."),
    "code-exec": ("Found: {}. Make sure that no outside input reaches it.", "Encontrado: {}. Garanta que nenhuma entrada externa chega aqui."),
    "timing-compare": ("The time taken tells how much agrees. Use a comparison of constant time.", "O tempo gasto revela o quanto coincide. Use uma comparação de tempo constante."),
    "workflow-permissions": ("Whoever controls this job can change the repository. Check each scope.", "Quem controla este job pode mudar o repositório. Verifique cada escopo."),
    "privileged-trigger": ("The event runs with the target's credentials. Check that no foreign code runs.", "O evento roda com as credenciais do destino. Verifique que nenhum código alheio roda."),
    "deleted-tests": ("Find what tests this now.", "Descubra o que testa isto agora."),
    "migration": ("Check the way back and the load on large tables.", "Verifique o caminho de volta e a carga em tabelas grandes."),
    "sensitive-surface": ("Errors here cost more than elsewhere.", "Erros aqui custam mais do que em outros lugares."),
    "missing-tests": ("No test of this diff belongs to {}.", "Nenhum teste deste diff pertence a {}."),
    "html-sink": ("Escape or clean the data where it is written.", "Escape ou limpe os dados onde são escritos."),
    "dependency-manifest": ("Compare the ranges with the resolved versions.", "Compare os intervalos com as versões resolvidas."),
    "runtime-config": ("Takes effect when deployed.", "Tem efeito na implantação."),
    "api-change": ("Callers depend on it.", "Quem chama depende disto."),
    "large-file": ("{} lines changed. Consider splitting it.", "{} linhas mudadas. Considere dividir."),
    "over-budget": ("About {} min.", "Cerca de {} min."),
    "lockfile": ("Look for packages nobody asked for.", "Procure pacotes que ninguém pediu."),
    "ci-publish": ("Check which event and which credential it takes.", "Verifique que evento e que credencial usa."),
    "ci-changed": ("Check triggers and secrets.", "Verifique gatilhos e segredos."),
    "binary-file": ("Lines can't be shown.", "Não há linhas para mostrar."),
    "whitespace-only": ("The words are the same.", "As palavras são as mesmas."),
    "generated-file": ("Read its source instead.", "Leia a fonte."),
}
HEADLINES = {
    "empty": ("No changes found", "Sem mudanças"), "high": ("Start at the top", "Comece pelo topo"), "medium": ("Some stops need care", "Algumas paradas pedem atenção"),
    "low": ("Quick read", "Leitura rápida"), "calm": ("Calm diff", "Diff tranquilo"),
}
#: files, additions, deletions, minutes, high findings, first names.
LEDE = ("%s files, +%s −%s, about %s min; %s high findings; start with %s", "%s ficheiros, +%s −%s, cerca de %s min; %s achados altos; comece por %s")
EMPTY_LEDE = ("This diff has no files.", "Este diff não tem ficheiros.")
EMPTY_HINT = ("No difference. Name a base, a patch file or a folder of patches.", "Sem diferença. Indique uma base, um arquivo ou uma pasta de patches.")
FOOTER = ("Scores order the reading; they prove nothing. No code was run.", "As notas ordenam a leitura; não provam nada. Nenhum código foi executado.")
ROLE_NAMES = {
    "test": ("Tests", "Testes"), "docs": ("Text", "Texto"), "ci": ("Build automation", "Automação"), "lockfile": ("Resolved versions", "Versões resolvidas"),
    "migration": ("Database change", "Mudança de banco"), "schema": ("Data shape", "Forma dos dados"), "config": ("Deployment", "Implantação"), "types": ("Type declarations", "Declarações de tipos"),
    "api": ("Interface", "Interface"), "auth": ("Access control", "Controle de acesso"), "crypto": ("Cryptography", "Criptografia"), "payment": ("Payments", "Pagamentos"),
    "deps": ("Requirements", "Requisitos"), "generated": ("Machine-made", "Feito por máquina"), "asset": ("Media", "Mídia"), "source": ("Code", "Código"),
}
CLUSTER_TITLES = {r: ROLE_NAMES[r] for r in CLUSTER_ROLES} | {"root": ("Top folder", "Pasta raiz")}
SURFACES = {"auth": ("access control", "controle de acesso"), "payment": ("payments", "pagamentos"), "crypto": ("cryptography", "criptografia")}
DISPOSITIONS = {"now": ("first", "primeiro"), "soon": ("next", "em seguida"), "later": ("last", "por último")}
LABELS = {"calm": ("calm", "calmo"), "low": ("low", "baixo"), "medium": ("medium", "médio"), "high": ("high", "alto"), "info": ("info", "info")}
STATUSES = {"added": ("new", "novo"), "modified": ("changed", "alterado"), "deleted": ("removed", "removido"), "renamed": ("moved", "movido"), "copied": ("duplicated", "duplicado")}
WORDS = {
    "order": ("Reading order", "Ordem de leitura"), "findings": ("Findings", "Achados"), "none": ("Nothing found.", "Nada encontrado."), "files": ("Files", "Ficheiros"), "clusters": ("Groups", "Grupos"),
    "was": ("Formerly", "Antes"), "binary": ("(binary content)", "(conteúdo binário)"), "no hunks": ("(no lines)", "(sem linhas)"), "cut": ("First 80 lines", "Primeiras 80 linhas"), "more": ("… %s more", "… mais %s"), "all": ("All", "Todos"),
}
