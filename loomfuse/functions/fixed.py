"""Word lists, patterns and constants that results depend on. Callers may pass others."""

# Row keys: names that tell phases, sections and kinds of object apart.
NUMERALS = "一二三四五六七八九十"
PHASE = r"([一二三四五六七八九十\d])\s*期"
SECTION = r"第?([一二三四五六七八九十\d])\s*标段"
DOMAINS = {
    "contract": ["合同", "协议", "合同书", "协议书"],
    "project": ["项目", "工程", "立项", "子项", "标段"],
    "entity": ["公司", "企业", "单位", "部门", "集团"],
}
GENERIC_PREFIXES = ["示例市", "示例县", "示例省", "示例新区", "示"]
GENERIC_SUFFIXES = [
    "旅游基础设施", "保护性开发", "基础设施", "建设项目", "建设工程", "工程项目", "开发项目", "项目沿线", "工程沿线", "保护性", "保障性",
    "沿线", "开发", "建设", "工程", "项目", "省级", "市级", "区级", "县级", "房",
]
ROAD = r"([^\s（(]*?(?:路|街|大道|道|高速|公路))\s*[（(]([^（）()]+)[）)]"
PARENTHESES = r"[（(][^）)]*[）)]"
IN_PARENTHESES = r"[（(]([^）)]*)[）)]"
RANGE_TAIL = r"[至到][^之及至到]*$"
SECTION_TAIL = r"[之及][^之及至到]*?(?:段|区间|幅)$"

# Fields: units, categories and directions.
UNITS = r"(万元|元|千元|亿元|平方米|平方公里|亩|公顷|个|人|台|套|件|公里|米|吨|立方米|立方|%|％|千克|公斤|升|毫升|天|小时|月|年|次|项)"
CATEGORIES = {
    "location": ["路", "街", "大道", "道", "巷", "弄", "胡同", "片区", "区", "县", "市", "省", "乡", "镇", "村", "环线", "高速", "公路", "桥", "隧道", "涵洞"],
    "project": ["项目", "工程", "立项", "子项", "标段", "建设"],
    "entity": ["公司", "企业", "单位", "集团", "部门", "机构", "事务所", "设计院"],
    "amount": ["金额", "投资", "费用", "预算", "概算", "决算", "结算", "估算", "万元", "元"],
    "date": ["时间", "日期", "年限", "工期"],
}
HOSTILE = [("location", "project"), ("location", "entity"), ("location", "amount"), ("entity", "amount"), ("entity", "date")]
HOSTILE_FACTOR = 0.35
START_WORDS, END_WORDS = ["开工"], ["竣工", "完工"]
TAGS = {"合同": ["合同", "协议", "合同书", "协议书"], "项目": ["项目", "工程", "立项", "子项"], "标段": ["标段"], "主体": ["公司", "企业", "单位", "集团"]}
PHASE_TAGS = ["立项", "可研", "设计", "勘察", "招标", "施工", "监理", "竣工", "验收", "运维", "前期", "建设", "规划"]
SOURCE_KEY_WORDS = ["项目", "编号", "名称", "合同", "立项", "标识"]
ROW_KEY_WORDS = ["立项", "名称", "项目", "工程", "标段", "合同", "协议", "编号"]

# Headers.
TOTAL_WORDS = ["合计", "总计", "小计", "求和", "汇总", "累计", "均值", "平均"]
HEADER_WORDS = [
    "dept", "name", "date", "amount", "id", "type", "no", "remark", "status", "qty", "unit", "person",
    "部门", "名称", "日期", "金额", "编号", "类型", "序号", "备注", "状态", "数量", "单位", "人员", "文号", "审批", "批复", "估算", "描述", "立项",
]

# Thresholds.
ROW_AUTO, ROW_SUGGEST = 0.85, 0.6
FIELD_AUTO, FIELD_SUGGEST = 85.0, 60.0

# Numbers as they stand in cells, thousands' marks and blanks taken out.
NUMBER = r"^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*(?:\.(?:[0-9]+(?:_[0-9]+)*)?)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?|(?i:nan|inf|infinity))$"

# Words that field names are made of, in the order in which they are taken out of a name (some stand twice).
FIELD_WORDS = [
    "项目", "工程", "名称", "编号", "编码", "代码", "建设", "施工", "设计", "监理", "审计", "主管", "负责", "联系", "单位", "方",
    "公司", "机构", "部门", "时间", "日期", "年限", "工期", "金额", "投资", "概算", "预算", "决算", "合同", "费用", "文号", "批复",
    "审批", "核准", "备案", "立项", "登记", "地址", "地点", "所在地", "规模", "面积", "占地", "建筑", "状态", "进展", "备注", "说明",
    "电话", "手机", "序号", "年度", "年份", "资金", "招标", "采购", "质量", "安全", "开工", "竣工", "完工", "验收", "计划", "实际",
    "可研", "初设", "施工图", "建议书", "论证", "评估", "评审", "审查", "估算", "决算", "结算", "建安", "建安费", "附件", "清单", "扫描件",
    "资金", "财政", "自筹", "贷款", "国债", "信贷", "融资", "用地", "占地", "建筑", "容积率", "密度", "绿地", "设计", "编制", "勘察",
    "法人", "责任人", "联络人", "代表", "可研报告", "初设报告", "评估报告", "论证报告", "投资估算", "设计概算", "施工图预算", "竣工决算", "竣工结算",
    "红线", "净收益", "土地", "出让金", "全称", "建设单位", "所属领域", "专业类别", "详细地址", "总投资额", "征拆", "拆迁", "年度计划", "月度", "累计",
    "方案估算", "批复金额", "审定金额", "已支付", "送审", "审减", "规划许可", "工规证", "征地", "施工图审查", "控制价", "上限值",
    "招标开标", "开标", "资金论证", "相对方", "发包方", "承包方", "签署", "补充协议", "勘察", "编制事务所", "一审", "二审", "审核", "造价咨询",
    "完成比例", "节点数", "滞后", "形象进度", "超时", "时效", "进窗", "审减率", "双控", "非双控", "收付款", "财务流程", "结算状态",
    "误差率", "责任", "归属", "划分", "分级", "资料编号", "比选", "内审", "接收方", "实际工期",
]
