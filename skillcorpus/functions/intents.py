"""What goals are about: rows of (pattern, tags), goals of two languages meeting on English tags."""

from __future__ import annotations

# Intent rows. A goal that a pattern fits gets the row's tags.
INTENTS = [
    (r"网站|网页|前端|界面|页面|落地页|\bweb\b|frontend|website|landing|\bui\b", "frontend web design artifact html react component"),
    (r"设计|视觉|品牌|配色|主题|排版|design|brand|visual|theme|color|typograph", "design visual brand theme color canvas typography"),
    (r"文案|写作|内容|撰写|博客|文章|沟通|writ|content|copy|blog|article|draft|comms|communicat", "writing content draft comms communicate coauthor"),
    (r"文档|word|报告|docx|document|report", "docx document word"),
    (r"\bpdf\b", "pdf"),
    (r"表格|excel|电子表|spreadsheet|数据表|xlsx", "xlsx spreadsheet"),
    (r"幻灯|演示文稿|\bppt|slide|presentation|pptx|deck", "pptx slide presentation"),
    (r"agent|智能体|代理|多智能体|编排|orchestrat|\bmcp\b|工具调用", "agent mcp tool sdk subagent parallel orchestrat server protocol builder"),
    (r"\bapi\b|接口|后端|backend|claude.?api|anthropic", "api sdk backend claude anthropic"),
    (r"cloudflare|边缘|worker|wrangler|edge|部署|上线|deploy|ship", "cloudflare worker edge wrangler deploy durable"),
    (r"数据库|存储|database|storage|durable|状态|stateful", "durable storage object stateful"),
    (r"测试|调试|排错|评审|审查|验收|质量|回归|test|debug|\bqa\b|review|verif", "test review debug verification driven systematic"),
    (r"代码评审|合并请求|拉取请求|\bpr\b|pull.?request|code.?review", "code review pull request verification"),
    (r"计划|规划|方案|头脑风暴|构思|想法|策划|需求|brainstorm|plan|planning|idea|strateg|requirement", "plan brainstorm planning idea requirement"),
    (r"\bgit\b|分支|版本|worktree|branch|提交|commit", "git worktree branch"),
    (r"技能|\bskill\b|做技能|写技能", "skill creator"),
    (r"安全|漏洞|security|secure|\bsafe\b|vulnerab", "security safe vulnerab"),
    (r"艺术|生成艺术|\bart\b|generative|creative.?coding|\bp5\b", "art algorithmic generative canvas"),
    (r"营销|推广|市场营销|获客|品牌推广|marketing|promot|campaign", "marketing ideas growth campaign psychology launch"),
    (r"\bseo\b|搜索引擎优化|自然流量|排名|收录|关键词|ranking|organic", "seo audit ranking technical meta page marketing"),
    (r"邮件|邮箱营销|\bedm\b|drip|newsletter|email|nurtur|营销序列", "email sequence drip nurtur campaign lifecycle marketing"),
    (r"发布|上线|发售|冷启动|go.?to.?market|\bgtm\b|launch|release|announcement|product.?hunt", "launch strategy release announcement product marketing"),
    (r"增长|留存|流失|转化|裂变|复购|growth|retention|churn|conversion|acquisition", "growth retention churn cohort adoption marketing"),
    (r"saas|订阅|续费|营收|收入|财务|\barr\b|\bmrr\b|\bltv\b|\bcac\b|\bnrr\b|指标|\bkpi\b|metric|revenue|finance", "saas metrics arr mrr churn ltv cac revenue financial analytics kpis"),
    (r"数据分析|产品分析|漏斗|同期群|留存分析|dashboard|analytics|cohort|adoption|funnel", "analytics product cohort retention adoption metric dashboards"),
    (r"路线图|产品路线|变更日志|更新日志|发布说明|roadmap|changelog|release.?notes|stakeholder|对外沟通", "roadmap release notes changelogs stakeholder narratives product"),
    (r"自媒体|新媒体|内容创作|博主|网红|涨粉|社媒|社交媒体|公众号|小红书|抖音|快手|视频号|creator|influencer|social.?media", "social content media posts creating platforms linkedin twitter instagram tiktok"),
    (r"短视频|视频脚本|视频文案|口播|拍视频|\bvlog\b|reel|shorts?|tiktok|油管|youtube|视频内容", "video content scripts youtube reels shorts strategy form"),
    (r"文案|带货|种草|标题党?|钩子|\bhook\b|copywrit", "content psychology persuasion marketing social posts"),
    (r"电商|网店|店铺|开店|独立站|跨境|选品|上架|商品详情|shopify|ecommerce|e-commerce|online.?store|storefront", "shopify store commerce product taxonomy seo landing ecom"),
    (r"漫画|漫剧|条漫|绘本|连环画|manhwa|manga|webtoon|\bcomic|分镜|storyboard|角色设定", "comic manhwa webtoon panel story storyboard art chapter script"),
    (r"音乐|作曲|编曲|歌曲|歌词|作词|配乐|混音|\bsuno\b|udio|\bmusic\b|\bsong\b|lyric|melody", "music suno lyric song album audio mastering genres prompts"),
    (r"转化率|转化优化|提高转化|弹窗|表单优化|注册流程|激活率|付费墙|升级弹窗|a\/?b\s*(测试|test)|\bcro\b|conversion|activation|split.?test|multivariate|popup|modal|paywall|signup.?flow|first.?run", "cro conversion conversions optimize popup signup onboarding paywall activation test marketing"),
    (r"投放|广告|买量|信息流|投流|\bppc\b|\bsem\b|paid.?(ads?|media|advertis|social)|google.?ads|meta.?ads|facebook.?ads|ad.?(copy|creative|campaign)|advertis", "ads paid advertising creative campaigns headlines marketing"),
    (r"冷邮件|开发信|陌生开发|外呼|销售线索|获客邮件|cold.?(email|outreach|call)|outbound|prospect|lead.?gen", "cold outreach emails prospects sales sequence marketing"),
    (r"裂变|老带新|转介绍|推荐计划|返佣|联盟营销|referral|affiliate|word.?of.?mouth|refer.?a.?friend", "referral affiliate program incentive growth marketing"),
    (r"落地页|着陆页|官网页面|建站|做官网|landing.?page|hero.?section|pricing.?page", "landing pages page hero tailwind react conversion marketing"),
    (r"结构化数据|富摘要|站点结构|内链|网站架构|收录问题|schema|structured.?data|json.?ld|rich.?(results|snippets)|sitemap|internal.?link|site.?architecture|url.?structure", "schema structured markup seo site architecture linking audit"),
    (r"应用商店|上架app|应用排名|\baso\b|app.?store|google.?play", "aso store keywords rankings metadata visibility optimization"),
    (r"定价|价格策略|涨价|收费方案|货币化|monetiz|pricing|price.?increase|升级付费", "pricing tiers paywall saas value upgrade revenue strategy"),
    (r"预测|营收预测|销售预测|业绩预测|forecast|bookings|projection|pipeline.?(forecast|review)", "forecast bookings arr projection pipeline quarterly revenue"),
    (r"并购|收购|尽调|估值|融资|投资分析|资本配置|m&a|merger|acquisition|due.?diligence|valuation|invest|fundrais|capital", "acquisition investment valuation diligence capital deal business financial"),
    (r"客户成功|客户留存|客户流失|续约|客服体系|customer.?(success|retention|support)|churn|\bnps\b|renewal", "retention customer churn segmentation onboarding activation"),
    (r"创始人|老板|高管|董事会|投资人汇报|战略会|founder|c.?suite|c.?level|\bceo\b|\bboard\b|executive|chief.?of.?staff|investor.?update", "founder board suite executive chief strategic advisor decision"),
    (r"决策|拍板|抉择|艰难决定|取舍|两难|decision|hard.?call|trade.?off|regret", "decision decisions strategic assumptions framework plan options"),
    (r"竞品|竞争对手|对标|市场调研|行业分析|competitor|competitive|battlecard|market.?research|positioning", "competitor competitive intelligence positioning research market analysis"),
    (r"调研|研究报告|深度研究|查资料|文献|多源|求证|research|investigat|triangulat|literature|evidence", "research sources investigation question analysis competitive"),
    (r"出海|国际化|海外市场|跨境扩张|全球化|international|expansion|go.?global|localiz|new.?countr", "international expansion market localization regulatory strategy region"),
    (r"内部沟通|团队沟通|周报|月报|全员信|公司通讯|状态汇报|internal.?comm|team.?comm|status.?(update|report)|company.?wide|all.?hands|incident.?report", "internal communications updates company status reports newsletters"),
    (r"收件箱|邮箱整理|清理邮件|理邮件|inbox|triage", "inbox triage email communications"),
    (r"流程管理|运营管理|供应商|采购|\bsop\b|业务流程|降本增效|operations|process.?doc|vendor|procurement|capacity.?plan|runbook", "operations business process internal vendor documentation planning"),
    (r"组织变革|变革管理|企业文化|公司文化|价值观|团队文化|change.?management|culture|values|organizational|adkar", "culture change management company values organizational behaviors"),
    (r"合规|质量体系|质量管理|医疗器械|体系认证|风险管理|\biso\s?\d|\bqms\b|complian|regulatory|medical.?device|13485|14971|risk.?management", "quality iso compliance regulatory risk management device audit"),
    (r"挑战我|盘问|压力测试|唱反调|泼冷水|红队|找茬|质疑|stress.?test|devil.?s.?advocate|grill|adversarial|critique|pre.?mortem|premortem|poke.?holes", "stress plan assumptions adversarial review critique grilled weaknesses"),
    (r"复盘|事后回顾|事故总结|retrospective|post.?mortem|postmortem|blameless|went.?wrong|5.?whys", "postmortem retrospective decision analysis whys failed"),
    (r"幻觉|别编造|不要编造|过度设计|极简代码|代码质量|克制|hallucinat|over.?engineer|yagni|invented?.?api|code.?quality|surgical", "code hallucinations verify simple assumptions apis review"),
    (r"上线前|发布前检查|预发检查|生产就绪|pre.?prod|production.?readiness|ship.?gate|release.?checklist|deploy.?audit|before.?deploy", "audit production security deploy codebase observability blocks"),
    (r"提示词|提示工程|管理prompt|prompt|评测|评估集|\beval\b|llm.?ops", "prompt prompts eval production versioning registries agent"),
    (r"演示视频|产品演示|录屏|讲解视频|产品视频|demo.?video|walkthrough|screencast|product.?tour", "demo video walkthrough product marketing showcase"),
    (r"爬虫|抓取|采集数据|数据抽取|scrap|crawl|firecrawl|data.?pipeline", "scraping crawling extraction parsing pipelines data web"),
]

# Concepts that a core skill must stand for, with how many of the tags it must match.
ANCHORS = [
    (r"\bpdf\b", "pdf", 1), (r"表格|excel|spreadsheet|xlsx", "xlsx spreadsheet", 1), (r"幻灯|演示文稿|\bppt|slide|presentation|pptx|deck", "pptx slide presentation", 1), (r"shopify", "shopify", 1),
    (r"漫画|漫剧|manhwa|manga|webtoon|comic", "comic manhwa webtoon", 1), (r"音乐|作曲|编曲|歌曲|歌词|suno|music|song|lyric", "music suno song lyric", 1), (r"\bseo\b|搜索引擎优化", "seo", 1), (r"路线图|roadmap", "roadmap", 1),
    (r"\barr\b|\bmrr\b|saas.{0,20}(?:指标|metric|churn)", "saas arr mrr", 2), (r"代码评审|合并请求|拉取请求|\bpr\b|pull.?request|code.?review", "code pull request", 1), (r"前端|frontend|react", "frontend react", 1), (r"cloudflare|workers?", "cloudflare worker", 1), (r"\bmcp\b", "mcp", 1),
]

# Wording of exclusions, words that exclude nothing, and what an exclusion means for capabilities.
NEGATION = r"(?i)(?:不要|不用|不使用|不需要|无需|无须|避免|排除|禁止|不得)\s*([^，。,.;；]+)|(?:without|avoid|exclude|do\s+not|don't|not\s+use|no)\s+([^,.;]+)"
NEGATION_STOP = "run running use using any the a an please skill skills".split()
FORBIDS = [("network", "网络|联网|network|internet|egress"), ("exec", "命令|shell|执行|exec|terminal"), ("install", "安装|install|package"), ("secret", "密钥|凭证|secret|credential|api.?key"), ("filesystem", "文件|filesystem")]
PLATFORMS = "twitter linkedin tiktok youtube shopify cloudflare".split()
BUILDING = r"(?i)搭建|创建|开发|\bbuild\b|\bcreate\b"

# Pairs of Chinese characters that tell nothing of a goal.
CJK_STOP = "一个 我要 我想 帮我 一下 什么 怎么 如何 可以 需要 一套 这个 那个".split()
