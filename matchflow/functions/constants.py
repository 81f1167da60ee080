"""Word lists, rates and thresholds. Results depend on exactly these."""

# fixed values: engineering-title terms (each may take a plural s)
ENGINEERING_TERMS = [
    "engineer", "engineering", "developer", "programmer", "software", "frontend", "front-end", "backend", "back-end",
    "fullstack", "full-stack", "devops", "sre", "site reliability", "platform engineer", "architect", "data engineer",
    "data scientist", "ml engineer", "machine learning engineer", "security engineer", "infrastructure", "reliability",
    "ios developer", "android developer", "mobile developer", "react native", "tech lead", "engineering manager",
    "engineering director", "cto", "vp of engineering", "head of engineering",
    "qa engineer", "test engineer", "automation engineer", "quality engineer", "ui engineer", "ux engineer",
]
# fixed values: web-development title terms (anywhere in the title)
WEBDEV_TERMS = [
    "frontend", "front-end", "front end", "backend", "back-end", "back end", "fullstack", "full-stack", "full stack",
    "web developer", "web engineer", "web development", "javascript", "typescript", "react", "next.js", "nextjs",
    "next js", "node", "node.js", "nodejs", "vue", "vue.js", "vuejs", "angular", "svelte", "sveltekit", "ember",
    "gatsby", "remix", "astro", "php", "laravel", "symfony", "wordpress", "wp developer", "drupal", "joomla", "magento",
    "shopify", "liquid", "webflow", "html", "css", "scss", "sass", "tailwind", "ui engineer", "ui developer",
    "ux engineer", "ux developer",
]
# fixed values: title patterns of quality-assurance roles
QA_TITLE_TERMS = [
    "qa", "quality assurance", "sdet", "test automation", "qa automation", "software tester", "test engineer",
    "automation engineer", "testing engineer",
]
# fixed values: the tag registry: tag, label, whether it can define a persona or supports one, category
TAG_REGISTRY = [
    ("javascript", "JavaScript", "persona_defining", "language"),
    ("typescript", "TypeScript", "persona_defining", "language"),
    ("python", "Python", "persona_defining", "language"), ("java", "Java", "persona_defining", "language"),
    ("csharp", "C#", "persona_defining", "language"), ("go", "Go", "persona_defining", "language"),
    ("rust", "Rust", "persona_defining", "language"), ("php", "PHP", "persona_defining", "language"),
    ("ruby", "Ruby", "persona_defining", "language"), ("swift", "Swift", "persona_defining", "language"),
    ("kotlin", "Kotlin", "persona_defining", "language"), ("c", "C", "persona_defining", "language"),
    ("cpp", "C++", "persona_defining", "language"), ("scala", "Scala", "persona_defining", "language"),
    ("elixir", "Elixir", "persona_defining", "language"), ("clojure", "Clojure", "persona_defining", "language"),
    ("haskell", "Haskell", "persona_defining", "language"), ("dart", "Dart", "persona_defining", "language"),
    ("lua", "Lua", "persona_defining", "language"), ("r", "R", "persona_defining", "language"),
    ("julia", "Julia", "persona_defining", "language"), ("sql", "SQL", "supporting", "language"),
    ("html", "HTML", "supporting", "language"), ("css", "CSS", "supporting", "language"),
    ("bash", "Bash/Shell", "supporting", "language"), ("powershell", "PowerShell", "supporting", "language"),
    ("react", "React", "persona_defining", "frontend"), ("nextjs", "Next.js", "persona_defining", "frontend"),
    ("vue", "Vue", "persona_defining", "frontend"), ("angular", "Angular", "persona_defining", "frontend"),
    ("svelte", "Svelte", "persona_defining", "frontend"), ("solidjs", "SolidJS", "persona_defining", "frontend"),
    ("gatsby", "Gatsby", "persona_defining", "frontend"), ("nuxt", "Nuxt", "supporting", "frontend"),
    ("sveltekit", "SvelteKit", "supporting", "frontend"), ("remix", "Remix", "supporting", "frontend"),
    ("astro", "Astro", "supporting", "frontend"), ("jquery", "jQuery", "supporting", "frontend"),
    ("htmx", "HTMX", "supporting", "frontend"), ("alpinejs", "Alpine.js", "supporting", "frontend"),
    ("tailwindcss", "Tailwind CSS", "supporting", "frontend"), ("bootstrap", "Bootstrap", "supporting", "frontend"),
    ("sass", "Sass/SCSS", "supporting", "frontend"),
    ("styled-components", "Styled Components", "supporting", "frontend"),
    ("redux", "Redux", "supporting", "frontend"), ("zustand", "Zustand", "supporting", "frontend"),
    ("react-query", "React Query", "supporting", "frontend"),
    ("tanstack-query", "TanStack Query", "supporting", "frontend"),
    ("nodejs", "Node.js", "persona_defining", "backend"), ("express", "Express", "persona_defining", "backend"),
    ("fastify", "Fastify", "persona_defining", "backend"), ("nestjs", "NestJS", "persona_defining", "backend"),
    ("deno", "Deno", "persona_defining", "backend"), ("bun", "Bun", "persona_defining", "backend"),
    ("django", "Django", "persona_defining", "backend"), ("flask", "Flask", "persona_defining", "backend"),
    ("fastapi", "FastAPI", "persona_defining", "backend"), ("rails", "Ruby on Rails", "persona_defining", "backend"),
    ("spring", "Spring", "persona_defining", "backend"),
    ("spring-boot", "Spring Boot", "persona_defining", "backend"),
    ("laravel", "Laravel", "persona_defining", "backend"), ("wordpress", "WordPress", "persona_defining", "backend"),
    ("aspnet", "ASP.NET", "persona_defining", "backend"), ("gin", "Gin", "persona_defining", "backend"),
    ("phoenix", "Phoenix", "persona_defining", "backend"), ("actix", "Actix", "persona_defining", "backend"),
    ("graphql", "GraphQL", "supporting", "backend"), ("apollo", "Apollo", "supporting", "backend"),
    ("trpc", "tRPC", "supporting", "backend"), ("prisma", "Prisma", "supporting", "backend"),
    ("drizzle", "Drizzle ORM", "supporting", "backend"), ("typeorm", "TypeORM", "supporting", "backend"),
    ("sequelize", "Sequelize", "supporting", "backend"), ("sqlalchemy", "SQLAlchemy", "supporting", "backend"),
    ("mongoose", "Mongoose", "supporting", "backend"), ("websocket", "WebSocket", "supporting", "backend"),
    ("grpc", "gRPC", "supporting", "backend"), ("rest", "REST API", "supporting", "backend"),
    ("postgresql", "PostgreSQL", "supporting", "database"), ("mysql", "MySQL", "supporting", "database"),
    ("mongodb", "MongoDB", "supporting", "database"), ("sqlite", "SQLite", "supporting", "database"),
    ("mariadb", "MariaDB", "supporting", "database"), ("mssql", "Microsoft SQL Server", "supporting", "database"),
    ("oracle", "Oracle DB", "supporting", "database"), ("dynamodb", "DynamoDB", "supporting", "database"),
    ("cassandra", "Cassandra", "supporting", "database"),
    ("elasticsearch", "Elasticsearch", "supporting", "database"), ("supabase", "Supabase", "supporting", "database"),
    ("firebase", "Firebase", "supporting", "database"), ("planetscale", "PlanetScale", "supporting", "database"),
    ("neo4j", "Neo4j", "supporting", "database"), ("influxdb", "InfluxDB", "supporting", "database"),
    ("redis", "Redis", "supporting", "database"), ("aws", "AWS", "persona_defining", "devops"),
    ("azure", "Azure", "persona_defining", "devops"), ("gcp", "Google Cloud", "persona_defining", "devops"),
    ("kubernetes", "Kubernetes", "persona_defining", "devops"), ("terraform", "Terraform", "supporting", "devops"),
    ("ansible", "Ansible", "supporting", "devops"), ("helm", "Helm", "supporting", "devops"),
    ("ci-cd", "CI/CD", "supporting", "devops"), ("github-actions", "GitHub Actions", "supporting", "devops"),
    ("gitlab-ci", "GitLab CI", "supporting", "devops"), ("jenkins", "Jenkins", "supporting", "devops"),
    ("nginx", "Nginx", "supporting", "devops"), ("apache", "Apache", "supporting", "devops"),
    ("traefik", "Traefik", "supporting", "devops"), ("vercel", "Vercel", "supporting", "devops"),
    ("netlify", "Netlify", "supporting", "devops"), ("cloudflare", "Cloudflare", "supporting", "devops"),
    ("linux", "Linux", "supporting", "devops"), ("prometheus", "Prometheus", "supporting", "devops"),
    ("grafana", "Grafana", "supporting", "devops"), ("docker", "Docker", "supporting", "devops"),
    ("react-native", "React Native", "persona_defining", "mobile"),
    ("flutter", "Flutter", "persona_defining", "mobile"), ("xamarin", "Xamarin", "persona_defining", "mobile"),
    ("ionic", "Ionic", "persona_defining", "mobile"), ("android", "Android", "persona_defining", "mobile"),
    ("ios", "iOS", "persona_defining", "mobile"), ("tensorflow", "TensorFlow", "persona_defining", "library"),
    ("pytorch", "PyTorch", "persona_defining", "library"), ("spark", "Apache Spark", "persona_defining", "library"),
    ("scikit-learn", "scikit-learn", "supporting", "library"), ("openai", "OpenAI API", "supporting", "library"),
    ("langchain", "LangChain", "supporting", "library"), ("huggingface", "Hugging Face", "supporting", "library"),
    ("pandas", "Pandas", "supporting", "library"), ("numpy", "NumPy", "supporting", "library"),
    ("kafka", "Apache Kafka", "supporting", "library"), ("rabbitmq", "RabbitMQ", "supporting", "library"),
    ("langgraph", "LangGraph", "supporting", "library"), ("llamaindex", "LlamaIndex", "supporting", "library"),
    ("crewai", "CrewAI", "supporting", "library"), ("autogen", "AutoGen", "supporting", "library"),
    ("semantic-kernel", "Semantic Kernel", "supporting", "library"),
    ("haystack", "Haystack", "supporting", "library"), ("dspy", "DSPy", "supporting", "library"),
    ("mastra", "Mastra", "supporting", "library"), ("vercel-ai-sdk", "Vercel AI SDK", "supporting", "library"),
    ("anthropic", "Anthropic Claude", "supporting", "library"), ("gemini", "Google Gemini", "supporting", "library"),
    ("mistral", "Mistral AI", "supporting", "library"), ("cohere", "Cohere", "supporting", "library"),
    ("deepseek", "DeepSeek", "supporting", "library"), ("aws-bedrock", "AWS Bedrock", "supporting", "devops"),
    ("azure-openai", "Azure OpenAI", "supporting", "devops"),
    ("vertex-ai", "Google Vertex AI", "supporting", "devops"), ("pinecone", "Pinecone", "supporting", "database"),
    ("weaviate", "Weaviate", "supporting", "database"), ("chromadb", "ChromaDB", "supporting", "database"),
    ("qdrant", "Qdrant", "supporting", "database"), ("milvus", "Milvus", "supporting", "database"),
    ("pgvector", "pgvector", "supporting", "database"), ("vllm", "vLLM", "supporting", "devops"),
    ("ollama", "Ollama", "supporting", "devops"), ("tensorrt", "TensorRT", "supporting", "devops"),
    ("llama-cpp", "llama.cpp", "supporting", "devops"), ("rag", "RAG", "persona_defining", "methodology"),
    ("prompt-engineering", "Prompt Engineering", "persona_defining", "methodology"),
    ("ai-agents", "AI Agents", "supporting", "methodology"),
    ("function-calling", "Function Calling", "supporting", "methodology"),
    ("mcp", "Model Context Protocol", "supporting", "methodology"), ("rlhf", "RLHF", "supporting", "methodology"),
    ("langsmith", "LangSmith", "supporting", "library"), ("langfuse", "Langfuse", "supporting", "library"),
    ("weights-and-biases", "Weights & Biases", "supporting", "library"), ("lora", "LoRA", "supporting", "library"),
    ("peft", "PEFT", "supporting", "library"), ("axolotl", "Axolotl", "supporting", "library"),
    ("unsloth", "Unsloth", "supporting", "library"), ("github-copilot", "GitHub Copilot", "supporting", "library"),
    ("cursor", "Cursor", "supporting", "library"), ("agile", "Agile", "supporting", "methodology"),
    ("scrum", "Scrum", "supporting", "methodology"), ("kanban", "Kanban", "supporting", "methodology"),
    ("tdd", "TDD", "supporting", "methodology"), ("bdd", "BDD", "supporting", "methodology"),
    ("git", "Git", "supporting", "methodology"), ("code-review", "Code Review", "supporting", "methodology"),
    ("pair-programming", "Pair Programming", "supporting", "methodology"), ("jest", "Jest", "supporting", "library"),
    ("vitest", "Vitest", "supporting", "library"), ("playwright", "Playwright", "supporting", "library"),
    ("cypress", "Cypress", "supporting", "library"), ("selenium", "Selenium", "supporting", "library"),
    ("testing-library", "Testing Library", "supporting", "library"), ("junit", "JUnit", "supporting", "library"),
    ("pytest", "pytest", "supporting", "library"),
]
# fixed values: spellings that stand for a tag where no label does
TAG_VARIANTS = {
    "golang": "go", "node.js": "nodejs", "node js": "nodejs", "nodejs": "nodejs", "react.js": "react",
    "reactjs": "react", "react js": "react", "next.js": "nextjs", "nextjs": "nextjs", "next js": "nextjs",
    "vue.js": "vue", "vuejs": "vue", "vue js": "vue", "nuxt.js": "nuxt", "nuxtjs": "nuxt", "angular.js": "angular",
    "angularjs": "angular", "svelte.js": "svelte", "sveltejs": "svelte", "express.js": "express",
    "expressjs": "express", "tailwind.css": "tailwindcss", "tailwind": "tailwindcss", "css3": "css", "html5": "html",
    "c++": "cpp", "c#": "csharp", "csharp": "csharp", "dotnet": "dotnet", ".net": "dotnet", "asp.net": "aspnet",
    "aspnet": "aspnet", "ruby on rails": "rails", "ruby-on-rails": "rails", "react-native": "react-native",
    "reactnative": "react-native", "react native": "react-native", "aws": "aws", "gcp": "gcp", "azure": "azure",
    "docker": "docker", "kubernetes": "kubernetes", "k8s": "kubernetes", "postgres": "postgresql",
    "postgresql": "postgresql", "mysql": "mysql", "mongodb": "mongodb", "redis": "redis", "graphql": "graphql",
    "rest api": "rest-api", "restapi": "rest-api", "rest-api": "rest-api",
}
# fixed values: stack families and their tags
STACK_FAMILIES = {
    "js": [
        "typescript", "javascript", "react", "nextjs", "nodejs", "vue", "nuxt", "express", "graphql", "tailwindcss",
        "svelte", "sveltekit", "remix", "gatsby", "astro", "solidjs", "preact", "angular", "ember", "backbone",
        "jquery", "vite", "webpack", "babel", "esbuild", "rollup", "parcel", "redux", "mobx", "zustand", "recoil",
        "tanstack", "react-query", "prisma", "drizzle", "trpc", "hono", "elysia", "fastify", "koa", "nestjs",
        "typeorm", "sequelize", "mongoose", "mongodb",
    ],
    "php": [
        "php", "laravel", "symfony", "wordpress", "drupal", "magento", "composer", "artisan", "blade", "eloquent",
        "livewire", "inertia", "codeigniter", "yii", "cakephp", "fuelphp", "slim",
    ],
    "ruby": [
        "ruby", "rails", "sinatra", "hanami", "padrino", "roda", "rspec", "minitest", "capybara", "sidekiq",
        "resque",
    ],
    "java": [
        "java", "spring", "spring-boot", "kotlin", "gradle", "maven", "hibernate", "jpa", "jakarta", "tomcat",
        "jetty", "quarkus", "micronaut", "vertx", "play", "akka", "scala", "clojure", "groovy",
    ],
    "dotnet": [
        "csharp", "dotnet", "aspnet", "fsharp", "vbnet", "razor", "blazor", "xamarin", "maui", "ef",
        "entity-framework", "linq", "signalr", "wcf", "wpf", "winforms",
    ],
    "python": [
        "python", "django", "flask", "fastapi", "tornado", "aiohttp", "asyncio", "celery", "pytest", "unittest",
        "pandas", "numpy", "scipy", "scikit-learn", "tensorflow", "pytorch", "keras", "jupyter", "streamlit",
        "gradio", "langchain", "llamaindex",
    ],
    "go": [
        "go", "golang", "gin", "echo", "fiber", "gorm", "chi", "cobra", "viper", "buf", "grpc-go",
    ],
    "rust": [
        "rust", "cargo", "tokio", "actix", "axum", "rocket", "serde", "warp", "tide", "diesel", "sqlx",
    ],
    "cpp": [
        "cpp", "cplusplus", "c", "qt", "boost", "stl", "cmake", "opencv", "cuda", "opencl", "mpi", "protobuf-c",
    ],
    "qa": [
        "selenium", "cypress", "playwright", "appium", "detox", "qa", "testing", "test-automation", "sdet",
        "qa-automation", "postman", "insomnia", "jmeter", "gatling", "k6",
    ],
}
# fixed values: tags of tools and habits, which say nothing about a stack
PROCESS_NOISE_TAGS = [
    "docker", "kubernetes", "k8s", "helm", "terraform", "ansible", "puppet", "chef", "vagrant", "docker-compose",
    "containerd", "ci-cd", "github-actions", "gitlab-ci", "jenkins", "circleci", "travis-ci", "teamcity", "bamboo",
    "argo", "drone", "aws", "azure", "gcp", "google-cloud", "cloudflare", "vercel", "netlify", "heroku",
    "digitalocean", "linode", "render", "agile", "scrum", "kanban", "tdd", "bdd", "code-review", "pair-programming",
    "saas", "b2b", "b2c", "git", "svn", "mercurial", "html", "css", "sass", "less", "sql", "postgresql", "mysql",
    "redis", "elasticsearch", "rabbitmq", "kafka", "nats", "rest", "graphql-schema", "json", "xml", "yaml", "toml",
    "grafana", "prometheus", "datadog", "sentry", "newrelic", "splunk", "elk", "jaeger", "zipkin", "jest", "vitest",
    "mocha", "chai", "testing-library", "linux", "unix", "bash", "shell", "make",
]
# fixed values: tags of which a routed posting must share one (canonical slugs)
DISTINCTIVE_TAGS = [
    "nextjs", "react", "vue", "nuxt", "svelte", "sveltekit", "remix", "astro", "nestjs", "graphql", "tailwindcss",
    "laravel", "wordpress", "drupal", "magento", "symfony", "prompt-engineering", "langchain", "django", "fastapi", "go", "rust",
]
# fixed values: tags outside the main focus, which cost display score unless a persona asks for them
OFF_FOCUS_TAGS = ["wordpress", "vue", "nuxt", "angular", "svelte", "solidjs", "php", "laravel", "ruby", "rails", "csharp", "dotnet", "aspnet", "swift", "kotlin", "flutter", "ios"]
# fixed values: routing thresholds and weights
MIN_OVERLAP, MAX_DISTANCE, ROUTE_LIMIT, TAG_WEIGHT, VECTOR_WEIGHT = 2, 0.75, 8, 0.6, 0.4
# fixed values: US dollars for one unit of a currency, and the least plausible yearly pay
USD_RATES = {
    "USD": 1, "EUR": 1.08, "GBP": 1.27, "CHF": 1.12, "CAD": 0.73, "AUD": 0.66, "PLN": 0.25, "CZK": 0.044, "HUF": 0.0028,
    "RON": 0.22, "BGN": 0.55, "HRK": 0.14, "SEK": 0.094, "NOK": 0.094, "DKK": 0.145, "UAH": 0.024, "RUB": 0.011,
    "TRY": 0.029, "INR": 0.012, "PKR": 0.0036, "BDT": 0.0091, "PHP": 0.017, "IDR": 0.000061, "MYR": 0.21, "SGD": 0.74,
    "JPY": 0.0067, "CNY": 0.14, "KRW": 0.00072, "VND": 0.000039, "THB": 0.028, "BRL": 0.2, "MXN": 0.059, "ARS": 0.0011,
    "COP": 0.00025, "CLP": 0.0011, "PEN": 0.27, "AED": 0.27, "SAR": 0.27, "ILS": 0.27, "ZAR": 0.054, "EGP": 0.021,
    "KES": 0.0077, "NGN": 0.00064,
}
PAY_FLOOR_USD = 5000
# fixed values: score of a company's discovery source
SOURCE_ORIGIN_SCORE = {
    "yc_directory": 15, "vc_portfolio": 15, "github_probe": 15, "funding_signal": 15, "frontend_job_scanner": 15,
    "workable_meta_search": 10, "hn_algolia": 5, "hn_custom_url": 5,
}
# fixed values: order of company tiers
TIERS = ["active_hot", "active", "probation", "dormant", "dead"]
# fixed values: regions that fence a posting, countries by the codes that texts are read for, and US state codes
REGION_TERMS = [
    "european union", "eu only", "europe only", "namer", "emea", "apac", "latam", "lac", "north america", "south america",
    "central america", "americas", "middle east", "mena", "gcc", "africa", "asia", "europe", "balkans", "eastern europe",
    "western europe", "nordics", "scandinavia", "caribbean", "benelux", "dach", "anz", "australasia", "oceania",
]
COUNTRIES = {
    "us": "US", "usa": "US", "u.s.": "US", "u.s": "US", "united states": "US", "america": "US", "uk": "GB", "u.k.": "GB",
    "united kingdom": "GB", "england": "GB", "britain": "GB", "scotland": "GB", "wales": "GB", "ireland": "IE",
    "republic of ireland": "IE", "germany": "DE", "france": "FR", "spain": "ES", "italy": "IT", "netherlands": "NL",
    "the netherlands": "NL", "holland": "NL", "poland": "PL", "portugal": "PT", "belgium": "BE", "switzerland": "CH",
    "austria": "AT", "sweden": "SE", "norway": "NO", "denmark": "DK", "finland": "FI", "iceland": "IS", "czechia": "CZ",
    "czech republic": "CZ", "greece": "GR", "romania": "RO", "bulgaria": "BG", "hungary": "HU", "slovakia": "SK",
    "slovenia": "SI", "croatia": "HR", "serbia": "RS", "estonia": "EE", "latvia": "LV", "lithuania": "LT",
    "luxembourg": "LU", "malta": "MT", "cyprus": "CY", "canada": "CA", "australia": "AU", "new zealand": "NZ",
    "india": "IN", "brazil": "BR", "mexico": "MX", "argentina": "AR", "colombia": "CO", "chile": "CL", "peru": "PE",
    "uruguay": "UY", "ecuador": "EC", "costa rica": "CR", "panama": "PA", "guatemala": "GT", "singapore": "SG",
    "japan": "JP", "south korea": "KR", "korea": "KR", "china": "CN", "philippines": "PH", "malaysia": "MY",
    "indonesia": "ID", "vietnam": "VN", "thailand": "TH", "taiwan": "TW", "hong": "HK", "hong kong": "HK",
    "israel": "IL", "turkey": "TR", "south africa": "ZA", "nigeria": "NG", "kenya": "KE", "egypt": "EG", "morocco": "MA",
    "saudi": "SA", "saudi arabia": "SA", "united arab emirates": "AE", "uae": "AE", "dubai": "AE",
}
# fixed values: the countries that a region's name stands for in a text
TEXT_REGIONS = {
    "eu": ["DE", "FR", "ES", "IT", "NL", "PL", "PT", "BE", "AT", "SE", "NO", "DK", "FI", "IE", "CZ", "GR", "RO", "BG", "HU", "SK", "SI", "HR", "EE", "LV", "LT"],
    "europe": ["DE", "FR", "ES", "IT", "NL", "PL", "PT", "BE", "AT", "SE", "NO", "DK", "FI", "IE", "CZ", "GR", "RO", "BG", "HU", "SK", "SI", "HR", "EE", "LV", "LT", "GB", "CH"],
    "european union": ["DE", "FR", "ES", "IT", "NL", "PL", "PT", "BE", "AT", "SE", "NO", "DK", "FI", "IE", "CZ", "GR", "RO", "BG", "HU", "SK", "SI", "HR", "EE", "LV", "LT"],
    "emea": ["DE", "FR", "ES", "IT", "NL", "PL", "PT", "GB", "IE", "CH", "AT", "SE", "NO", "DK", "FI", "CZ", "GR", "RO", "BG", "HU", "SK", "SI", "HR", "EE", "LV", "LT", "ZA", "NG", "KE", "EG", "MA", "SA", "AE", "IL", "TR"],
    "apac": ["AU", "NZ", "IN", "SG", "JP", "KR", "CN", "PH", "MY", "ID", "VN", "TH", "TW", "HK"],
    "asia pacific": ["AU", "NZ", "IN", "SG", "JP", "KR", "CN", "PH", "MY", "ID", "VN", "TH", "TW", "HK"],
    "latam": ["BR", "MX", "AR", "CO", "CL", "PE"],
    "latin america": ["BR", "MX", "AR", "CO", "CL", "PE"],
    "north america": ["US", "CA", "MX"],
    "balkans": ["RS", "HR", "SI", "BG", "RO", "HU", "GR", "AL", "MK", "BA", "ME"],
    "eastern europe": ["PL", "CZ", "SK", "HU", "RO", "BG", "HR", "SI", "RS", "EE", "LV", "LT", "UA", "BY"],
}
# fixed values: the countries that a location can name, in the order in which one is looked for
LOCATION_COUNTRIES = {
    "RS": ["serbia", "rs"], "US": ["united states", "usa", "u.s.", "us", "america"], "CA": ["canada", "ca"],
    "GB": ["uk", "united kingdom", "england", "scotland", "wales", "britain"], "AU": ["australia", "au"],
    "DE": ["germany", "de"], "FR": ["france", "fr"], "IN": ["india", "in"], "BR": ["brazil", "br"], "AR": ["argentina", "ar"],
    "MX": ["mexico", "mx"], "CO": ["colombia", "co"], "PT": ["portugal", "pt"], "IE": ["ireland", "ie"],
    "RO": ["romania", "ro"], "UA": ["ukraine", "ua"], "CH": ["switzerland", "ch"], "MT": ["malta", "mt"],
    "TW": ["taiwan", "tw"], "MY": ["malaysia", "my"], "PL": ["poland", "pl"], "ES": ["spain", "es"], "IT": ["italy", "it"],
    "NL": ["netherlands", "nl"], "SE": ["sweden", "se"], "NO": ["norway", "no"], "DK": ["denmark", "dk"],
    "FI": ["finland", "fi"], "CZ": ["czech republic", "czechia", "cz"], "AT": ["austria", "at"], "BE": ["belgium", "be"],
    "HU": ["hungary", "hu"], "GR": ["greece", "gr"], "BG": ["bulgaria", "bg"], "HR": ["croatia", "hr"],
    "SK": ["slovakia", "sk"], "SI": ["slovenia", "si"], "LT": ["lithuania", "lt"], "LV": ["latvia", "lv"],
    "EE": ["estonia", "ee"], "IS": ["iceland", "is"], "LU": ["luxembourg", "lu"], "JP": ["japan", "jp"],
    "KR": ["south korea", "korea", "kr"], "CN": ["china", "cn"], "SG": ["singapore", "sg"], "HK": ["hong kong", "hk"],
    "TH": ["thailand", "th"], "VN": ["vietnam", "vn"], "ID": ["indonesia", "id"], "PH": ["philippines", "ph"],
    "PK": ["pakistan", "pk"], "BD": ["bangladesh", "bd"], "TR": ["turkey", "türkiye", "tr"], "IL": ["israel", "il"],
    "AE": ["united arab emirates", "uae", "ae"], "SA": ["saudi arabia", "sa"], "ZA": ["south africa", "za"],
    "EG": ["egypt", "eg"], "MA": ["morocco", "ma"], "KE": ["kenya", "ke"], "NG": ["nigeria", "ng"], "CL": ["chile", "cl"],
    "PE": ["peru", "pe"], "UY": ["uruguay", "uy"], "EC": ["ecuador", "ec"], "VE": ["venezuela", "ve"], "BO": ["bolivia", "bo"],
    "PY": ["paraguay", "py"], "DO": ["dominican republic", "do"],
}
# fixed values: words of a location that is no place, and names of broad regions
REMOTE_INDICATORS = ["remote", "global", "worldwide", "anywhere", "distributed", "work from", "any location", "any country"]
BROAD_REGIONS = [
    "european union", "eu", "emea", "apac", "latam", "north america", "south america", "europe", "asia", "africa",
    "middle east", "balkans", "eastern europe", "western europe", "central europe", "nordics", "benelux", "dach",
]
# fixed values: the countries of the broad regions
REGION_MEMBERS = {
    "european union": ["AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE"],
    "eu": ["AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE"],
    "apac": ["AU", "NZ", "CN", "JP", "KR", "IN", "ID", "TH", "VN", "MY", "SG", "PH", "HK", "TW", "BD", "PK", "LK", "KH", "LA", "MM", "BN", "FJ", "PG", "SB", "VU", "NC", "PF", "GU", "MP", "KH", "TL"],
    "emea": [
        "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE", "GB", "IS", "LI", "NO", "CH",
        "TR", "IL", "AE", "SA", "QA", "KW", "BH", "OM", "JO", "LB", "IQ", "IR", "EG", "MA", "DZ", "TN", "LY",
        "RS", "AL", "BA", "MK", "ME", "XK", "UA", "MD", "BY", "RU", "GE", "AM", "AZ",
    ],
    "latam": ["BR", "AR", "MX", "CO", "CL", "PE", "VE", "EC", "BO", "PY", "UY", "CR", "PA", "DO", "GT", "HN", "SV", "NI", "CU", "PR"],
    "north america": ["US", "CA", "MX", "GL"],
    "south america": ["BR", "AR", "CO", "CL", "PE", "VE", "EC", "BO", "PY", "UY", "GY", "SR"],
    "europe": [
        "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT", "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE", "GB", "IS", "LI", "NO", "CH",
        "RS", "AL", "BA", "MK", "ME", "XK", "UA", "MD", "BY", "RU",
    ],
    "asia": ["CN", "JP", "KR", "IN", "ID", "TH", "VN", "MY", "SG", "PH", "HK", "TW", "BD", "PK", "LK", "KH", "LA", "MM", "BN", "KZ", "UZ", "TM", "KG", "TJ", "AF", "MN", "NP", "BT"],
    "africa": [
        "NG", "ZA", "EG", "MA", "DZ", "TN", "LY", "KE", "ET", "GH", "UG", "TZ", "CM", "CI", "SN", "ML", "BF", "GN", "BJ", "TG", "RW", "BI", "MZ", "AO", "ZM", "ZW", "BW", "NA", "LS", "SZ", "MG", "MR", "SL", "LR",
        "TD", "CF", "CG", "CD", "SO", "SS", "ER", "DJ", "KM", "SC", "ST", "GQ", "GA",
    ],
    "middle east": ["TR", "IL", "AE", "SA", "QA", "KW", "BH", "OM", "JO", "LB", "IQ", "IR", "SY", "YE", "PS"],
    "balkans": ["RS", "AL", "BA", "MK", "ME", "XK", "HR", "SI", "RO", "BG", "GR"],
    "eastern europe": ["PL", "CZ", "SK", "HU", "RO", "BG", "RS", "AL", "BA", "MK", "ME", "XK", "UA", "MD", "BY", "RU", "LT", "LV", "EE", "HR", "SI"],
    "western europe": ["AT", "BE", "FR", "DE", "IE", "LU", "NL", "CH", "GB", "LI"],
    "central europe": ["AT", "CZ", "DE", "HU", "PL", "SK", "SI", "CH", "LI"],
    "nordics": ["DK", "FI", "IS", "NO", "SE"],
    "benelux": ["BE", "NL", "LU"],
    "dach": ["DE", "AT", "CH"],
}
# fixed values: regions of a title's end: pattern, region; and those that suit an applicant of a country
TITLE_REGIONS = [
    (r"-?\s*(latam|latin\s*america)\b", "Latam"), (r"-?\s*(apac|asia[- ]?pacific)\b", "APAC"),
    (r"-?\s*(emea|europe[- ]?middle[- ]?east[- ]?africa)\b", "EMEA"), (r"-?\s*(balkans|eastern\s*europe)\b", "Eastern Europe"),
    (r"-?\s*india\b", "India"), (r"-?\s*(us[- ]?only|united\s*states[- ]?only)\b", "US Only"), (r"-?\s*(canada[- ]?only)\b", "Canada Only"),
]
FRIENDLY_REGIONS = {
    "RS": ["emea", "europe", "eu", "european union", "balkans", "eastern europe", "global", "worldwide", "remote"],
    "US": ["united states", "us only", "north america", "global", "worldwide", "remote"],
}
# fixed values: compliance by which an applicant abroad can work for US employers
US_COMPLIANCE = ["w8ben", "ic_global"]
# fixed values: demands of a work permit or residence, and wording that welcomes contractors from anywhere
WORK_AUTH_FENCES = [
    r"\bmust\s+be\s+(?:authorized|eligible)\s+to\s+work\s+(?:in|within)\b", r"\bmust\s+reside\s+in\b",
    r"\beligible\s+to\s+work\s+in\b", r"\bauthorized\s+to\s+work\s+in\b",
    r"\bmust\s+have\s+(?:work\s+)?authorization\s+(?:for|in)\b", r"\brequires\s+(?:work\s+)?authorization\s+(?:for|in)\b",
    r"\bonly\s+(?:accepting|considering)\s+(?:candidates|applicants)\s+(?:from|in|located\s+in)\b",
    r"\bcandidates\s+must\s+be\s+(?:based|located)\s+in\b",
]
CONTRACTOR_WELCOMES = [
    r"\bwork\s+from\s+anywhere\b", r"\bglobal\s+remote\b", r"\bremote\s*[-–]\s*global\b", r"\bdistributed\s+team\b",
    r"\bworldwide\s+remote\b", r"\bany\s+location\b", r"\bany\s+country\b", r"\bwork\s+from\s+any\s+country\b",
    r"\bcontractor\s+friendly\b", r"\bopen\s+to\s+(?:remote|global)\s+(?:contractors|candidates)\b", r"\bw-?8ben\b",
    r"\bic_global\b", r"\bindependent\s+contractor\b",
]
# fixed values: titles and texts of senior work
SENIOR_TITLE = r"senior|sde\s*2|sde\s*ii|lead|staff|principal"
SENIOR_TEXT = r"senior\s*(ownership|responsibility|level)\s*expected"
# fixed values: countries that fence a title or location
FENCED_COUNTRIES = [
    "argentina", "brazil", "colombia", "mexico", "canada", "chile", "peru", "uruguay", "ecuador", "costa rica", "panama",
    "guatemala", "germany", "france", "spain", "italy", "portugal", "netherlands", "holland", "poland", "ukraine", "romania",
    "ireland", "sweden", "norway", "denmark", "finland", "iceland", "belgium", "austria", "switzerland", "czech republic",
    "czechia", "greece", "bulgaria", "hungary", "slovakia", "slovenia", "croatia", "serbia", "estonia", "latvia", "lithuania",
    "luxembourg", "malta", "cyprus", "india", "pakistan", "bangladesh", "sri lanka", "nepal", "philippines", "vietnam",
    "indonesia", "malaysia", "singapore", "thailand", "taiwan", "hong kong", "japan", "south korea", "korea", "china",
    "australia", "new zealand", "south africa", "nigeria", "kenya", "egypt", "morocco", "ghana", "israel", "uae", "dubai",
    "saudi arabia", "turkey", "qatar", "bahrain", "kuwait", "oman", "jordan", "lebanon", "united kingdom", "uk", "england",
    "scotland", "wales",
]
NAMED_COUNTRIES = ["united states", "usa", "u.s.", "u.s.a.", "america", "dominican republic", "puerto rico", "monaco"] + FENCED_COUNTRIES
FENCING_REGIONS = (
    r"\b(european union|namer|emea|apac|latam|north america|south america|central america|americas|middle east|mena|gcc|balkans|"
    r"eastern europe|western europe|nordics|scandinavia|dach|benelux|anz|australasia|oceania)\b"
)
FENCES = [
    r"\b(u\.?s\.?a?\.?|united states)\s*[-/]?\s*remote\b", r"\bremote\s*[\[(]\s*(u\.?s\.?a?\.?|united states|usa)\s*[\])]",
    r"\bremote\s*[,;:-]\s*(u\.?s\.?a?\.?|united states|usa)\b", r"\bremote\s+within\s+",
    r"\bremote\s*[;,-]\s*(" + "|".join(FENCED_COUNTRIES) + r")\b", r"\bremote\s*,\s*([a-z]{2})\b", FENCING_REGIONS,
]
US_STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri "
    "sc sd tn tx ut vt va wa wv wi wy dc"
).split()
# fixed values: a source's words for a posting that is closed, and sources that list open postings only
CLOSED_STATUSES = ["closed", "archived", "inactive", "filled", "unpublished", "draft", "expired", "on_hold", "on-hold", "paused"]
OPEN_ONLY_SOURCES = ["greenhouse", "lever", "ashby", "workable"]
# fixed values: the least text that is normalised
MIN_TEXT_CHARS = 100
# fixed values: platforms in titles: name, pattern, stack family ("enterprise" is nobody's)
PLATFORM_PATTERNS = [
    ("SharePoint", r"\bsharepoint\b", "dotnet"), ("Sitecore", r"\bsitecore\b", "dotnet"),
    ("Episerver/Optimizely", r"\bepiserver\b|\boptimizely\b", "dotnet"),
    (".NET/C#", r"(?:^|[\s/|(])\.net\b|(?:^|[\s/|(])c#|(?:^|[\s/|(])csharp\b|(?:^|[\s/|(])asp\.net\b|(?:^|[\s/|(])aspnet\b|(?:^|[\s/|(])blazor\b", "dotnet"),
    ("SAP", r"\bsap\b|\babap\b", "enterprise"), ("Oracle", r"\boracle\s+(?:developer|engineer|dba)\b|\bplsql\b|\bpl/sql\b", "enterprise"),
    ("ServiceNow", r"\bservicenow\b", "enterprise"), ("Salesforce", r"\bsalesforce\b|\bapex\s+developer\b|\bvisualforce\b", "enterprise"),
    ("Dynamics 365", r"\bdynamics\s*365\b|\bdynamics\s+(?:ax|nav|crm|gp)\b", "enterprise"),
    ("AEM (Adobe Experience Manager)", r"\baem\b|\badobe\s+experience\s+manager\b", "java"),
    ("Magento", r"\bmagento\b", "php"), ("Drupal", r"\bdrupal\b", "php"), ("WooCommerce", r"\bwoocommerce\b", "php"),
    ("WordPress", r"\bwordpress\b|\bwp\s+developer\b", "php"), ("Shopify", r"\bshopify\b|\bliquid\s+developer\b", "js"),
    ("Contentful", r"\bcontentful\b", "js"), ("Storyblok", r"\bstoryblok\b", "js"), ("BigCommerce", r"\bbigcommerce\b", "js"),
    ("Webflow", r"\bwebflow\b", "js"),
]
# fixed values: role families in titles: name, pattern, tags of a persona that lift the block
ROLE_FAMILY_PATTERNS = [
    ("Architect", r"\b(?:solutions?\s+architect|software\s+architect|systems?\s+architect|cloud\s+architect|data\s+architect|enterprise\s+architect|technical\s+architect)\b", []),
    ("DevOps/SRE/Platform", r"\b(?:devops|dev\s+ops|sre|site\s+reliability|platform\s+engineer|infrastructure\s+engineer|release\s+engineer|build\s+engineer)\b", ["docker", "kubernetes", "terraform", "ansible", "aws", "gcp", "azure"]),
    ("Data Engineer", r"\b(?:data\s+engineer|data\s+infrastructure|data\s+platform|etl\s+engineer|data\s+pipeline)\b", ["python", "sql", "airflow", "dbt", "spark"]),
    ("AI Engineer (application)", r"\bai\s+engineer\b", []),
    ("ML Engineer (research)", r"\b(?:ml\s+engineer|machine\s+learning\s+engineer|deep\s+learning|nlp\s+engineer|computer\s+vision|research\s+engineer)\b", ["python", "ml", "langchain", "pytorch", "tensorflow"]),
    ("Mobile", r"\b(?:mobile\s+(?:developer|engineer)|ios\s+(?:developer|engineer)|android\s+(?:developer|engineer)|react\s+native|flutter|swift\s+developer|kotlin\s+(?:developer|engineer))\b", ["react-native", "swift", "kotlin", "flutter", "mobile"]),
    ("QA/SDET", r"\b(?:qa\s+(?:engineer|lead|automation)|quality\s+assurance|quality\s+engineer|sdet|software\s+(?:development\s+)?engineer\s+in\s+test|test\s+automation\s+engineer|automation\s+tester|test\s+engineer)\b", ["qa", "sdet", "testing", "test-automation", "playwright", "cypress", "selenium"]),
    ("Engineering Manager", r"\b(?:engineering\s+manager|engineering\s+director|head\s+of\s+engineering|vp\s+of\s+engineering|director\s+of\s+engineering|tech\s+lead|team\s+lead|lead\s+developer)\b", []),
    ("Security Engineer", r"\b(?:security\s+engineer|appsec|devsecops|penetration\s+tester|pentester|vulnerability\s+researcher)\b", ["security", "appsec", "devsecops"]),
]
# fixed values: what lifts the blocks of management and of AI application roles
MANAGEMENT_LEVELS = ["manager", "lead", "director"]
PROMPT_TAG, JS_SIGNAL_TAGS = "prompt-engineering", ["typescript", "javascript", "react", "nextjs", "nodejs", "vue", "nuxt", "svelte", "sveltekit"]
# fixed values: reasons of rejections: the first pattern that the blockers show
REJECTION_REASONS = [
    ("scope_text_restriction", r"scope_text_restriction"),
    ("non_development_role", r"\b(non-development|non-development role|not a software development|bookkeeper|account executive|sales role|accountant|financial analyst|marketing manager|operations manager|chief of staff|it support|help desk)\b"),
    ("management_role", r"management/pm role|management role|pm role"),
    ("geo_region_fenced", r"\b(apac|emea|latam|europe|asia|africa|north america|south america|balkans|eastern europe|western europe|region)\b"),
    ("geo_country_fenced", r"\b(country|poland|india|canada|argentina|pakistan|ukraine|germany|france|netherlands|spain|italy|portugal|romania|bengaluru|mumbai|delhi|pune|gujarat|hong kong|singapore|reside|residency|authorized|eligible|location restriction|foreign country|commute|on-site|hybrid job)\b"),
    ("stack_mismatch", r"\b(tech stack|must-have|java|spring|nodejs|node\.js|angular|python|fastapi|pixi|backend skill|frontend focus|next\.js|graphql|wrong tech|stack|alignment|primary.*language|core.*skill)\b"),
    ("seniority_mismatch", r"\b(seniority|senior|junior|mid|lead|staff|principal|years.*experience|overqualified|underqualified|inverted.*band)\b"),
    ("contract_compliance", r"\b(contractor|compliance|employment|w-2|w2|visa|sponsorship|payroll|benefits|work authorization|work auth|citizenship|permit|green card)\b"),
    ("stale", r"\b(stale|expired|closed|no longer|removed|filled)\b"),
]
# fixed values: probes of a region fence: name, pattern, weight (2 high, 1 medium); two points make a fence
REGION_PROBES = [
    ("utc_range", r"\bUTC[-+]\d+\s+to\s+UTC[-+]?\d+\b", 2),
    ("gmt_range", r"\bGMT[-+]\d+\s+to\s+GMT[-+]?\d+\b", 2),
    ("timezone_named", r"\b(?:working\s+hours|timezone|time\s+zone).*?(?:UTC|GMT|EST|PST|CET|EET|IST|JST|AEST|PST|EST)\b", 2),
    ("region_hours", r"\b(?:EMEA|APAC|Latam|Americas|Europe|Asia|Africa)\s+(?:hours|timezone|time)\b", 2),
    ("must_be_in_region", r"\bmust\s+(?:be\s+)?(?:based|located|reside|live)\s+in\s+(?:Europe|Asia|Africa|South\s+America|North\s+America|EMEA|APAC|Latam|the\s+EU|the\s+UK|the\s+US)\b", 2),
    ("candidates_from_region", r"\bcandidates\s+(?:from|in|based\s+in)\s+(?:Europe|Asia|Africa|South\s+America|North\s+America|EMEA|APAC|Latam)\b", 2),
    ("work_auth_country", r"\b(?:eligible|authorized)\s+to\s+work\s+(?:in|for)\s+(?:the\s+)?(?:US|USA|UK|EU|Germany|France|India|Poland|Brazil|Canada|Australia|Singapore|Netherlands|Ireland)\b", 2),
    ("visa_required", r"\bmust\s+(?:have|possess|hold)\s+(?:a\s+)?(?:work\s+)?(?:visa|permit)\s+(?:for|in)\s+", 2),
    ("only_from", r"\bonly\s+(?:accepting|considering|hiring)\s+(?:candidates\s+)?(?:from|in)\s+", 2),
    ("salary_currency_non_usd", r"\b(?:salary|compensation|pay).*?(?:EUR|GBP|PLN|INR|BRL|CAD|AUD|SGD|ZAR|AED|SEK|NOK|DKK|CHF)\b", 1),
    ("core_hours_overlap", r"\b(?:core|business)\s+hours\s+(?:overlap|with)\s+", 1),
    ("during_business_hours", r"\bduring\s+(?:our|the)\s+(?:business|core|working)\s+hours\b", 1),
    ("overlap_hours", r"\boverlap\s+(?:with|of)\s+\d+\s+hours?\b", 1),
]
# fixed values: wording that makes a posting global whatever its location says
ALWAYS_GLOBAL = [r"\bwork\s+from\s+anywhere\b", r"\banywhere\s+in\s+the\s+world\b", r"\bwork\s+from\s+any\s+location\b", r"\bany\s+country\b", r"\bno\s+location\s+restrictions?\b"]
# fixed values: strong wording of a global posting
GLOBAL_SIGNALS = [
    r"\banywhere\s+in\s+the\s+world\b", r"\bworldwide\b", r"\bwork\s+from\s+anywhere\b", r"\bwork\s+from\s+any\s+location\b", r"\bany\s+country\b", r"\bany\s+location\b",
    r"\bremote[- ]first\b", r"\bdistributed\s+(?:team|company|workforce|organization)\b", r"\bglobal\s+remote\b", r"\bremote\s*[-–]\s*(?:global|worldwide|anywhere)\b",
    r"\bfully\s+remote\s+worldwide\b", r"\b(?:global[,\s]+remote|remote[,\s]+global)\b", r"\bno\s+location\s+restrictions?\b", r"\blocation\s+independent\b", r"\bborderless\b",
    r"\bteam\s+members\s+across\s+\d+\s+countries\b", r"\boperates?\s+in\s+\d+\s+countries\b",
]
# fixed values: strong wording of a country fence: pattern, country ("" where the context names it)
COUNTRY_SIGNALS = [
    (r"\b(?:us|usa|u\.s\.?)\s+only\b", "US"), (r"\bw-?2\s+only\b", "US"), (r"\be-?verify\b", "US"),
    (r"\beligibility\s+to\s+work\s+in\s+(?:the\s+)?(?:u\.?s\.?a?\.?|united\s+states)\b", "US"),
    (r"\bauthorized\s+to\s+work\s+in\s+(?:the\s+)?(?:u\.?s\.?a?\.?|united\s+states)\b", "US"),
    (r"\bremote\s+(?:within|in|restricted)\b", ""), (r"\bmust\s+(?:be\s+)?(?:located|reside)\s+in\b", ""),
]
# fixed values: names of countries that fence by "X only" and the like, and their codes
FENCING_COUNTRIES = [
    (["us", "usa", "u\\.s\\.?", "united states"], "US"), (["uk", "u\\.k\\.?", "united kingdom", "england", "britain"], "GB"), (["canada"], "CA"), (["germany"], "DE"), (["france"], "FR"),
    (["netherlands", "holland"], "NL"), (["spain"], "ES"), (["italy"], "IT"), (["australia"], "AU"), (["india"], "IN"), (["brazil"], "BR"), (["singapore"], "SG"), (["ireland"], "IE"),
    (["switzerland"], "CH"), (["sweden"], "SE"), (["poland"], "PL"), (["portugal"], "PT"), (["japan"], "JP"), (["south korea", "korea"], "KR"), (["costa rica"], "CR"), (["chile"], "CL"),
    (["argentina"], "AR"), (["mexico"], "MX"), (["colombia"], "CO"),
]
# fixed values: strong wording of a region fence: pattern, region
REGION_SIGNALS = [
    (r"\b(?:eu|european\s+union)\s+only\b", "eu"), (r"\bmust\s+(?:be\s+)?(?:based|located)\s+in\s+(?:the\s+)?eu\b", "eu"), (r"\bemea\s+only\b", "emea"), (r"\bapac\s+only\b", "apac"),
    (r"\blatam\s+only\b", "latam"), (r"\bnorth\s+america\s+only\b", "north america"), (r"\bremote\s*[-–]\s*(?:latam|latin\s+america)\b", "latam"),
    (r"\bremote\s*[-–]\s*(?:apac|asia[- ]?pacific)\b", "apac"), (r"\bremote\s*[-–]\s*(?:emea|europe[- ]?middle[- ]?east[- ]?africa)\b", "emea"),
    (r"\bremote\s*[-–]\s*(?:balkans|eastern\s+europe)\b", "balkans"), (r"\bremote\s*[-–]\s*(?:eu|europe|european\s+union)\b", "eu"),
]
# fixed values: weaker wording: pattern (letter case counts where it has capitals), scope
MEDIUM_SIGNALS = [
    (r"(?i)\bremote\s*[-:]\s*(?:us|usa|u\.s\.?)\b", "country_fenced"), (r"(?i)\bremote\s*[-:]\s*(?:uk|u\.k\.?)\b", "country_fenced"), (r"(?i)\bremote\s*[-:]\s*ca\b", "country_fenced"),
    (r"(?i)\bremote\s*[-:]\s*de\b", "country_fenced"), (r"(?i)\bremote\s*[-:]\s*fr\b", "country_fenced"), (r"(?i)\bremote\s*[-:]\s*nl\b", "country_fenced"),
    (r"(?i)\bremote\s*[-:]\s*(?:eu|emea|apac|latam)\b", "region_fenced"), (r"\bmust\s+(?:live|reside|be\s+based)\s+in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", "country_fenced"),
    (r"\bright\s+to\s+work\s+(?:in|for)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", "country_fenced"), (r"(?i)\bbased\s+in\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:only|required)\b", "country_fenced"),
    (r"(?i)\bfully\s+remote\b", "global"), (r"(?i)\b100\s?%\s+remote\b", "global"), (r"(?i)\bremote\s+work\s+(?:available|option|opportunity)\b", "global"),
]
# fixed values: wording that speaks against a scope: pattern, reason, whether against every remote scope or the global one alone
NEGATIVE_SIGNALS = [
    (r"(?i)\brelocation\s+(?:required|offered|provided|assistance)\b", "relocation_required", "global"), (r"(?i)\b(?:hybrid|on[- ]site|in[- ]office)\b", "hybrid_onsite", "all_remote"),
    (r"(?i)\blocal\s+candidates?\s+(?:only|preferred)\b", "local_candidates_only", "global"), (r"\bmust\s+(?:be\s+)?(?:in|based\s+in)\s+[A-Z][a-z]+,\s+[A-Z][a-z]+\b", "city_level_restriction", "global"),
]
# fixed values: demands of presence, and groups of regions of which three make a location global
ONSITE_SIGNALS = [r"\bon[- ]site\s+(?:position|role|job|work)\b", r"\bin[- ]office\s+(?:position|role|required)\b", r"\bmust\s+(?:work|be)\s+(?:on[- ]site|in[- ]office)\b"]
MACRO_REGIONS = [
    ["americas", "north america", "south america", "latam", "latin america"], ["europe", "european", "emea"], ["asia", "apac", "asia-pacific"], ["africa"],
    ["middle east"], ["oceania", "australasia"],
]
# fixed values: wording of a global and of a fenced posting on the first pass
FIRST_GLOBAL = [
    r"\bremote\s*[-–]\s*(?:global|worldwide|anywhere)\b", r"\b(?:global[,\s]+remote|remote[,\s]+global)\b",
    r"\bremote[- ]first\s+(?:organization|company|team|startup)\b", r"\bwork\s+from\s+anywhere\b", r"\bwork\s+from\s+any\s+location\b",
    r"\bany\s+country\b", r"\bany\s+location\b", r"\bworldwide\b", r"\bdistributed\s+(?:team|workforce|company|organization)\b",
    r"\bteam\s+members\s+across\s+\d+\s+countries\b", r"\boperates?\s+in\s+\d+\s+countries\b", r"\banywhere\s+in\s+the\s+world\b",
    r"\banywhere\s+in\s+the\s+globe\b",
]
FIRST_FENCED = [
    r"\bremote\s*[-–]\s*(?:us|usa|united\s+states|u\.s\.)\b", r"\bremote\s*[-–]\s*(?:uk|united\s+kingdom|england)\b",
    r"\bremote\s*[-–]\s*(?:eu|europe|european\s+union)\b", r"\bremote\s*[-–]\s*(?:germany|france|spain|italy|netherlands|poland|portugal)\b",
    r"\bremote\s*[-–]\s*(?:canada|australia|india|brazil|mexico|argentina|colombia)\b", r"\bremote\s*[-–]\s*(?:latam|apac|emea|balkans|eastern\s+europe)\b",
    r"\bremote\s+(?:within|in|only|restricted)\b", r"\bmust\s+(?:be\s+)?(?:located|reside)\s+in\b", r"\b(?:us|uk|eu)\s+only\b", r"\bnorth\s+america\s+only\b",
    r"\bauthorized\s+to\s+work\s+in\s+(?:the\s+)?(?:united\s+states|us|u\.s\.|india|canada|philippines|uk|australia|germany|france)\b",
    r"\bmust\s+be\s+based\s+in\s+(?:the\s+)?(?:united\s+states|us|u\.s\.|india|canada|uk|australia)\b",
    r"\beligible\s+to\s+work\s+in\s+(?:the\s+)?(?:united\s+states|us|canada|uk|australia|germany|france)\b",
    r"\bmust\s+be\s+a\s+(?:united\s+states|us|u\.s\.)\s+citizen\b", r"\bremote\s+within\s+(?:the\s+)?(?:united\s+states|colombia|india|canada|uk|australia)\b",
    r"\banywhere\s+in\s+(?:the\s+)?(?:us|u\.s\.|usa|united\s+states|uk|u\.k\.|united\s+kingdom|canada|australia|germany|france|spain|italy|netherlands|poland|portugal|india|brazil|mexico|argentina|colombia)\b",
    r"\bthrive\s+from\s+anywhere\s+in\s+(?:the\s+)?(?:us|u\.s\.|usa|united\s+states)\b",
]
# fixed values: words of national security: those that suffice, those that need one of a clearance, and those
NATSEC_WORDS = [
    "security clearance", "top secret", "ts/sci", "ts/sci clearance", "secret clearance", "confidential clearance",
    "public trust clearance", "clearance required", "must have clearance", "active clearance", "eligible for clearance",
    "clearance eligibility", "us citizen", "u.s. citizen", "united states citizen", "us citizenship", "u.s. citizenship",
    "must be a us citizen", "american citizen", "national of the united states", "itar", "export control",
    "export controlled", "ear-controlled", "itar-controlled", "itars", "dod", "department of defense", "dod contract",
    "defense contract", "government contract", "federal contract", "federal contractor", "national security",
    "homeland security", "law enforcement", "intelligence community", "central intelligence", "cia", "fbi", "nsa", "dhs",
    "space force", "air force", "navy", "army", "marines", "pentagon", "fort ", "naval ", "air force base", "public trust",
    "position of public trust", "background investigation", "polygraph", "counterintelligence",
    "security clearance required", "must be able to obtain clearance", "us person", "u.s. person", "us person status",
]
NATSEC_HINTS = [
    "e-verify", "everify", "e verify", "background check required", "background investigation", "public trust",
    "position of public trust", "polygraph", "counterintelligence",
]
CLEARANCE_WORDS = [
    "security clearance", "top secret", "ts/sci", "secret clearance", "confidential clearance", "clearance required",
    "active clearance", "eligible for clearance", "clearance eligibility", "must be able to obtain clearance",
    "security clearance required", "itar", "export control", "export controlled", "ear-controlled", "itar-controlled",
    "department of defense", "defense contract", "national security", "homeland security", "intelligence community",
    "counterintelligence",
]

#: Fixed value: what the message of a run holds that failed on a payload of another form.
VALIDATION_FAILURE = "Zod validation failed"

#: Elements whose text is no content, and containers of the main text in order of priority.
BOILERPLATE_TAGS = ["nav", "footer", "header", "aside", "script", "style", "noscript", "iframe", "svg", "form", "button"]
MAIN_CONTAINERS = [
    "main", '[role="main"]', "article", ".jobs", ".careers", ".job-listing", ".job-description",
    '[class*="job-description"]', '[class*="jd-content"]', '[id*="job-description"]',
]

#: The same for probed pages, and what names a job, between word borders and in either letter case.
PROBE_BOILERPLATE_TAGS = ["nav", "footer", "header", "aside", "script", "style"]
PROBE_CONTAINERS = ["main", '[role="main"]', "article", ".jobs", ".careers", ".job-listing", ".job-description"]
JOB_TITLE_PATTERNS = [
    r"(senior|junior|lead|staff|principal)\s+(engineer|developer|designer|product\s+manager|data\s+scientist)",
    r"(software|backend|frontend|full[- ]?stack|devops|sre|site\s+reliability)\s+(engineer|developer)",
    r"(engineer|developer|designer|product\s+manager|program\s+manager|project\s+manager)",
]

#: Tracking systems that are polled, and boards with remote work only.
TRACKING_SYSTEMS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "recruitee"]
REMOTE_NATIVE_BOARDS = ["remoteok_direct", "weworkremotely", "remotive", "himalayas_direct", "arbeitnow", "wellfound", "remotecom", "larajobs"]

#: Metric, from (open?), to (open?), tier, action and severity of the breaker's rules.
BREAKER_RULES = [
    ("failures_first", 3.0, False, None, False, 1, "pause_source_15min", "hard_pause"),
    ("failures_again", 3.0, False, None, False, 1, "pause_source_1hr", "hard_pause"),
    ("backlog", 0.15, True, 0.25, False, 2, "rate_reduce_50", "rate_reduction"),
    ("backlog", 0.25, True, 0.3, False, 2, "rate_reduce_90", "rate_reduction"),
    ("backlog", 0.3, True, None, False, 2, "pause_source_until_clear", "hard_pause"),
    ("unknown_share", 0.3, False, None, False, 3, "force_reclassify", "hard_pause"),
    ("known_ratio", None, False, 0.15, True, 4, "halt_non_global_ingestion", "hard_pause"),
    ("escalations", 3.0, False, None, False, 5, "ban_source_24hr", "hard_pause"),
]

#: Fixed value: distance below which vectors alone make a match, where they are a gate and not a rank.
GATE_DISTANCE = 0.55

#: Slugs that are words of site navigation or placeholders.
NAVIGATION_SLUGS = [
    "login", "register", "signup", "sign-up", "signin", "sign-in", "careers", "jobs", "job", "admin", "dashboard", "settings", "profile", "account", "about", "contact", "help", "support", "faq", "privacy", "terms", "api",
    "docs", "blog", "news", "press", "team", "company", "home", "index", "search", "apply", "post", "new", "edit", "delete", "create", "view", "list", "all", "none", "null", "undefined", "test", "demo", "example", "sample",
    "temp", "tmp", "foo", "bar", "baz",
]

#: What a text says of work permits in one country, as patterns between word borders.
PERMIT_PATTERNS = [r"e-?verify", r"eligibility\s+to\s+work\s+in\s+(?:the\s+)?(?:u\.?s\.?a?\.?|united\s+states)", r"authorized\s+to\s+work\s+in\s+(?:the\s+)?(?:u\.?s\.?a?\.?|united\s+states)"]

#: Categories of blockers in the order in which they are tried, as patterns in either letter case.
BLOCKER_CATEGORIES = {
    "geographic": "remote.*(restrict|US only|must be located|must reside|region|country)", "workplace": "(on-site|onsite|hybrid|workplace)", "skills": "(not mentioned|missing|requires.*skill|skill)", "travel": "(travel|relocation)",
    "domain": "(Angular|jQuery|web3|React Native|Vue|Ember|Backbone)",
}

#: Tags of front-end work.
FRONTEND_TAGS = ["react", "vue", "angular", "typescript", "javascript", "css", "html", "frontend", "front-end", "svelte", "nextjs", "tailwind"]
