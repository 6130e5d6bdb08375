"""Chinese texts of findings, verdicts, gates and edits. In both languages ``#1``, ``#2`` … stand for numbers and grades."""

from __future__ import annotations

# What the report says, by what the engine says.
TITLES = {
    "Downloads and runs a remote script (curl … | sh)": "下载并运行远程脚本（curl … | sh）",
    "Possible prompt injection / instruction hijack": "疑似提示注入 / 指令劫持",
    "Possible data-exfiltration intent": "疑似数据外泄意图",
    "Possible obfuscated / encoded payload": "疑似混淆 / 编码过的载荷",
    "Reads private keys / cloud credentials": "读取私钥 / 云凭证",
    "References API keys / env config": "引用 API key / 环境变量配置",
    "Dynamic code execution / spawns a process": "动态执行代码 / 起子进程",
    "Destructive file operation": "破坏性文件操作",
    "Privilege escalation / changes exec permission": "提权 / 修改可执行权限",
    "Embedded shell script block": "内嵌 shell 脚本块",
    "Makes outbound network requests": "发起对外网络请求",
    "Contains curl / wget network command": "包含 curl / wget 网络命令",
    "Hard-coded IP address": "硬编码的 IP 地址",
    "References a .env file": "引用了 .env 文件",
    "Missing YAML frontmatter": "缺少 YAML frontmatter",
    "Missing name field": "缺少 name 字段",
    "Non-standard name": "name 命名不规范",
    "Missing description field": "缺少 description 字段",
    "Body has no section headings": "正文没有分节标题",
    "Description too short / vague": "description 太短 / 太笼统",
    "Description too long": "description 太长",
    "Description doesn’t say WHEN to use it": "description 没说清什么时候该用它",
    "Trigger is too broad": "触发条件太宽泛",
    "Over the spec’s body budget": "超出官方正文 token 预算",
    "Over the spec’s line budget": "超出官方 500 行预算",
    "Could defer detail to references/": "可把细节挪进 references/",
    "Description contains filler": "description 里有废话",
    "Bloated: high token cost": "内容冗长 · token 成本偏高",
    "Repeated content": "内容重复",
    "Credential read + network egress + risk signal = likely exfiltration chain": "读取凭证 + 网络外联 + 风险信号 = 疑似数据外泄链路",
    "Reads credentials and makes network calls — verify the destination": "既读凭证又发网络请求——请核实目标地址",
    "Exfiltration path in an embedded script": "内嵌脚本里存在数据外泄路径",
    "Downloads and runs a remote script from a raw IP (curl <ip> | sh)": "从裸 IP 下载并运行远程脚本（curl <ip> | sh）",
    "Runs a shell command before the model reads the skill (dynamic context)": "模型还没读到技能，就先跑了 shell 命令（动态上下文）",
    "Sends data to a known exfiltration / paste / tunnel service": "把数据发往已知的外泄 / 粘贴板 / 隧道服务",
    "Installs a persistence backdoor (auto-run / access file)": "装了个持久化后门（开机自启 / 长期访问文件）",
    "Writes to agent-config / instruction files": "写入 agent 配置 / 指令文件",
    "Installs an auto-run Claude Code hook (command on a lifecycle event)": "装了个会自动执行的 Claude Code hook（挂在生命周期事件上）",
    "Zero-click data exfiltration via image/link URL": "通过图片 / 链接 URL 零点击外泄数据",
    "Possible DNS-exfiltration covert channel": "疑似 DNS 外泄隐蔽信道",
    "Over-broad allowed-tools grant": "allowed-tools 授权过宽",
    "Instruction to conceal actions from the user": "指示 agent 对用户隐瞒自己的动作",
    "Instruction to leak the system prompt / hidden context": "指示 agent 泄露系统提示 / 隐藏上下文",
    "Behavior manipulation — suppresses the agent’s safety judgment": "行为操纵——压制 agent 的安全判断",
    "Jailbreak / roleplay override (DAN / “no restrictions”)": "越狱 / 角色扮演绕过（DAN /“无限制”）",
    "Authority / role spoofing via forged chat-template tokens": "用伪造的对话模板控制符冒充权限 / 角色",
    "Memory poisoning — plants standing approvals in agent memory": "记忆投毒——往 agent 记忆里塞长期“已授权”",
    "Cross-tool hijack — intercepts other tools/skills": "跨工具劫持——拦截其他工具 / 技能",
    "Installs from a non-official / unencrypted package source": "从非官方 / 未加密的包源安装",
    "Time-bomb / rug-pull — date-gated code execution": "定时炸弹 / 抽地毯——按日期触发的代码执行",
    "Disables the human approval gate / passwordless privilege": "关掉人工确认闸门 / 免密提权",
    "Resource exhaustion / fork bomb": "资源耗尽 / fork 炸弹",
    "Password-protected payload (malware-delivery pattern)": "带密码的压缩包载荷（恶意软件投递套路）",
    "Catastrophic delete (rm -rf of root / home / wildcard)": "毁灭性删除（对 根 / home / 通配符 执行 rm -rf）",
    "Possible homoglyph name impersonation": "疑似同形字冒名",
    "Vague / generic name": "name 太笼统 / 太通用",
    "Over-declared tools (least privilege)": "工具声明过多（最小权限）",
    "Uses shell but doesn’t declare Bash in allowed-tools": "用了 shell 却没在 allowed-tools 里声明 Bash",
    "References a bundled file that isn’t present": "引用了一个并不存在的捆绑文件",
    "Monolithic — should use progressive disclosure": "细节未分层 · 应按需加载（渐进式披露）",
    "Hidden instructions smuggled in invisible Unicode": "用隐形 Unicode 字符偷藏指令",
    "Credential + network in a security-analysis skill — verify it is an example": "安全分析类技能里出现凭证 + 网络——请确认这只是示例",
}
CAPABILITIES = {
    "executes code": "执行代码", "runs encoded content": "运行编码内容", "reads secrets": "读取密钥", "network egress": "网络外联", "escalates privilege": "提权", "writes / deletes files": "写入 / 删除文件", "installs packages": "安装依赖包",
}
EDITS = {
    "Removed a filler sentence from the description": "删掉了 description 里的一句废话", "Removed vague “various related things”": "删掉了含糊的“various related things”", "Removed “of any kind”": "删掉了“of any kind”", "Trimmed a verbose example preamble": "精简了啰嗦的示例开场白",
    "Removed “carefully step by step” padding": "删掉了“carefully step by step”这类凑字", "Trimmed trailing whitespace": "清理了行尾多余的空白", "Shortened “in order to” → “to”": "把“in order to”缩成了“to”", "Shortened “due to the fact that” → “because”": "把“due to the fact that”缩成了“because”",
    "Shortened “for the purpose of” → “to”": "把“for the purpose of”缩成了“to”", "Shortened “in the event that” → “if”": "把“in the event that”缩成了“if”", "Shortened “at this point in time” → “now”": "把“at this point in time”缩成了“now”", "Shortened “a large number of” → “many”": "把“a large number of”缩成了“many”",
    "Shortened “the majority of” → “most”": "把“the majority of”缩成了“most”", "Removed “please note that” filler": "删掉了“please note that”这类凑字", "Removed “it is important to note that” filler": "删掉了“it is important to note that”这类凑字",
    "Removed #1 duplicate lines": "删除了 #1 行重复内容", "Removed #1 duplicate line": "删除了 #1 行重复内容", "Grade #1 → #2 — sharper description/trigger": "触发描述更精准了 —— 评分从 #1 提到 #2", "−#1% tokens (#2 → #3)": "正文压缩 #1% —— #2 → #3 token", "Tighter wording (grade #1, #2 tokens)": "措辞更紧凑了（评分 #1，#2 token）",
}
VERDICTS = {
    "Serious security risk — blocked, do not ship": "存在严重安全风险——已拦截，请勿上线", "Risk too high — blocked, fix before shipping": "风险过高——已拦截，修好再上线", "Usable, but has fixable issues — human review recommended": "可以用，但有一些能修的问题——建议人工复核", "Clean and low-risk — safe to merge": "干净、低风险——可以放心合并",
    "Safe to merge": "可安全合并", "Needs review": "需要复核", "Blocked": "已拦截",
}
WARNED = (" — in a warning", " —— 出现在警告里")
CAPABILITY = ("Script capability: ", "脚本能力：")
#: What stands in a text for a slot.
SLOT = r"\d[\d,]*|\b[A-F]\b"
