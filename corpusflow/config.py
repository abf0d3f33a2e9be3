"""Parameters with the legal corpus' values as defaults. Every operator takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: lists of the legal corpus, as published with it -------------------------------
TITLE_KEYWORDS = (
    "doanh nghiệp", "hỗ trợ doanh nghiệp nhỏ và vừa", "đầu tư", "kinh doanh", "thuế", "hóa đơn", "kế toán", "kiểm toán", "phá sản", "thương mại", "lao động",
    "bảo hiểm xã hội", "bảo hiểm y tế", "bhxh", "bhyt", "việc làm", "công đoàn", "hợp đồng", "sở hữu trí tuệ", "góp vốn", "cổ phần", "chi nhánh",
)
FIELDS = (
    "Doanh nghiệp", "Đầu tư", "Thương mại", "Thuế - Phí - Lệ Phí", "Kế toán - Kiểm toán", "Lao động - Tiền lương", "Bảo hiểm", "Tài chính nhà nước",
    "Tiền tệ - Ngân hàng", "Xuất nhập khẩu", "Sở hữu trí tuệ", "Chứng khoán", "Quyền dân sự", "Vi phạm hành chính",
)
SECTORS = ("Doanh nghiệp", "Tài chính", "Lao động", "Thương mại", "Đầu tư")
DOCUMENT_TYPES = (
    "Sắc lệnh", "Quyết định", "Chỉ thị", "Nghị quyết", "Thông tư liên tịch", "Thông tư", "Nghị định", "Pháp lệnh", "Lệnh", "Luật", "Sắc luật", "Chương trình",
    "Công ước", "Nghị định thư", "Hiến pháp", "Bộ luật", "Nghị quyết liên tịch", "Thông báo", "Hiệp định", "Văn bản hợp nhất", "Công văn", "Bản ghi nhớ", "None",
    "Thỏa thuận", "Nghị Quyết", "Thông tư liên bộ", "Văn bản khác", "Văn bản liên quan",
)
STATUS = "Còn hiệu lực"
RELATION_LABELS = {
    "Văn bản sửa đổi bổ sung": "AMENDS",
    "Văn bản bị sửa đổi bổ sung": "AMENDED_BY",
    "Văn bản thay thế": "REPLACES",
    "Văn bản bị thay thế": "REPLACED_BY",
    "Văn bản hướng dẫn": "DETAILS",
    "Văn bản được hướng dẫn": "DETAILED_BY",
    "Văn bản được dẫn chiếu": "CITED_BY_REF",
    "Văn bản được căn cứ": "BASIS_OF",
    "Văn bản hợp nhất": "CONSOLIDATES",
    "Văn bản được hợp nhất": "CONSOLIDATED_BY",
    "Văn bản đính chính": "CORRECTS",
    "Văn bản bị đính chính": "CORRECTED_BY",
    "Văn bản liên quan ngôn ngữ": "RELATED_LANGUAGE",
    "Văn bản liên quan cùng nội dung": "RELATED_CONTENT",
}
TRAVERSED_RELATIONS = ("DETAILS", "DETAILED_BY", "AMENDS", "AMENDED_BY", "REPLACES", "REPLACED_BY", "CITES_REF", "BASIS_OF")
#: Edge labels that exist but that no source label maps to.
UNMAPPED_RELATIONS = ("CITES_REF", "BASED_ON")
SHOWN_RELATIONS = ("DETAILS", "AMENDS", "REPLACES")
CONCEPTS = (
    "vốn điều lệ", "vốn pháp định", "doanh nghiệp tư nhân", "công ty cổ phần", "công ty TNHH", "công ty hợp danh", "hợp đồng lao động", "hợp đồng kinh tế",
    "bảo hiểm xã hội", "bảo hiểm y tế", "bảo hiểm thất nghiệp", "thuế giá trị gia tăng", "thuế thu nhập doanh nghiệp", "thuế thu nhập cá nhân", "hóa đơn điện tử",
    "hóa đơn giá trị gia tăng", "người lao động", "người sử dụng lao động", "đại hội đồng cổ đông", "hội đồng quản trị", "ban kiểm soát", "kiểm soát viên",
    "giám đốc", "tổng giám đốc", "chi nhánh", "văn phòng đại diện", "địa điểm kinh doanh", "sáp nhập", "chia tách", "hợp nhất", "giải thể", "phá sản", "góp vốn",
    "chuyển nhượng vốn", "cổ phần ưu đãi", "cổ phần phổ thông", "thời giờ làm việc", "thời giờ nghỉ ngơi", "tiền lương", "phụ cấp", "kỷ luật lao động", "sa thải",
    "chấm dứt hợp đồng lao động", "đầu tư trong nước", "đầu tư nước ngoài", "ưu đãi đầu tư",
)
ARTICLE_WORD = "Điều"
HEADING_PATTERN = r"^\s*Điều\s+(\d+)([a-zđ]?)\s*(?:[\.:\-–—)]\s*)?(.*)$"
HEADER_PATTERNS = {
    "phan": r"^\s*(Phần(?:\s+thứ)?\s+[\dIVXLCDM\w]+.*)$",
    "chuong": r"^\s*(Chương\s+[\dIVXLCDM\w]+.*)$",
    "muc": r"^\s*(Mục\s+[\dIVXLCDM\w]+.*)$",
}
LAW_LIKE_PATTERN = r"\b(Luật|Bộ luật|Nghị định)\b"
CLAUSE_START = r"(?=^\s*\d+\.\s)"
SENTENCE_END = r"(?<=[.!?])\s+"
LAW_NUMBER_PATTERN = r"\d+/\d{4}/[A-ZĐ-]+"
FALLBACK_TITLE = "Toàn văn văn bản"
DISCLAIMER = "Thông tin mang tính tham khảo, không thay thế tư vấn pháp lý chính thức."
DISCLAIMER_MARKS = ("tham khảo", "không thay thế")
NO_RELATIONS = "(Không có quan hệ chéo đáng chú ý)"
SUMMARY_PROMPT = """Hãy tạo HAI tóm tắt cho điều luật dưới đây:

[ĐIỀU LUẬT]
{text}

[YÊU CẦU]
1) SUM_SHORT: 1 câu duy nhất (≤30 từ) nêu CHỦ ĐỀ chính của điều.
2) SUM_KEY: 3-5 gạch đầu dòng nêu các Ý PHÁP LÝ then chốt
   (đối tượng áp dụng, nghĩa vụ, quyền, điều kiện, chế tài).

Trả về JSON: {"short": "...", "key": ["...", "..."]}"""
SUMMARY_SYSTEM = "Bạn là chuyên gia tóm tắt văn bản pháp luật Việt Nam."
#: A model's reply: a flat JSON object with both fields, else the widest braces.
REPLY_PATTERNS = (r'(?s)(\{[^{}]*"short"\s*:\s*"[^"]*"(?:,\s*"key"\s*:\s*\[[^\]]*\])?[^{}]*\})', r"(?s)(\{.*\})")
ANSWER_SYSTEM = """Bạn là Trợ lý Pháp lý cho doanh nghiệp nhỏ và vừa (SME) tại Việt Nam.
Bạn CHỈ được dùng các CĂN CỨ PHÁP LUẬT được cung cấp; tuyệt đối không
bịa ra điều luật hay văn bản khác. Luôn trích dẫn dưới dạng "Điều X của
<Tên văn bản>". Khi căn cứ không đủ → nói rõ và đề xuất tham vấn chuyên gia."""
RELATIONS_HEADING = "QUAN HỆ VĂN BẢN LIÊN QUAN (từ knowledge graph):"
ANSWER_PROMPT = """CÂU HỎI: {question}

CĂN CỨ PHÁP LUẬT TOP-{K}:
{contexts}

QUAN HỆ VĂN BẢN LIÊN QUAN (từ knowledge graph):
{graph_context}

Hãy trả lời theo cấu trúc:
1) KẾT LUẬN NGẮN GỌN (2-3 câu)
2) PHÂN TÍCH CHI TIẾT — mỗi luận điểm trích dẫn "Điều X của <Tên văn bản>"
3) LƯU Ý TUÂN THỦ / RỦI RO (nếu có)
4) CẢNH BÁO: "Thông tin mang tính tham khảo, không thay thế tư vấn pháp lý chính thức."
"""
# --- end of fixed values ------------------------------------------------------------------------


@dataclass(frozen=True)
class Scope:
    title_keywords: tuple[str, ...] = TITLE_KEYWORDS
    fields: tuple[str, ...] = FIELDS
    sectors: tuple[str, ...] = SECTORS
    document_types: tuple[str, ...] = DOCUMENT_TYPES
    status: str = STATUS
    least_rows: int = 3_000
    most_rows: int = 20_000


@dataclass(frozen=True)
class Retrieval:
    top_lexical: int = 50
    top_dense: int = 50
    rrf_k: int = 60
    fused_top: int = 30
    discount_doc: float = 0.6
    discount_concept: float = 0.3
    expanded_top: int = 50
    rerank_chars: int = 2000
    final_top: int = 5
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Decoding:
    """What a model behind a Generator is asked for."""

    max_new_tokens: int = 900
    do_sample: bool = False
    temperature: float = 0.1
    repetition_penalty: float = 1.05


@dataclass(frozen=True)
class Limits:
    min_body: int = 30
    max_tokens: int = 1024
    preview: int = 500
    summary_input: int = 3000
    context_body: int = 1500
    fallback_body: int = 200
    min_answer: int = 200
