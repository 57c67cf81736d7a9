"""The published search texts of the reference, per dialect and name, with the filters that are added to them there."""

# fmt: off
PUBLISHED: dict[str, dict[str, str]] = {
    "pubmed": {
        "main": '(("single cell"[Title/Abstract] OR "single-cell"[Title/Abstract] OR scRNA-seq[Title/Abstract] OR "RNA-seq"[Title/Abstract] OR "RNA seq"[Title/Abstract] OR "gene expression"[Title/Abstract] OR scATAC-seq[Title/Abstract] OR "ATAC-seq"[Title/Abstract] OR "chromatin accessibility"[Title/Abstract] OR CITE-seq[Title/Abstract] OR "spatial transcriptomics"[Title/Abstract] OR "multi-omics"[Title/Abstract] OR "multi omics"[Title/Abstract] OR multiomics[Title/Abstract] OR transcriptomics[Title/Abstract] OR genomics[Title/Abstract] OR proteomics[Title/Abstract] OR epigenomics[Title/Abstract] OR "cell type"[Title/Abstract] OR "gene regulatory"[Title/Abstract]) AND ("language model"[Title/Abstract] OR LLM[Title/Abstract] OR "large language model"[Title/Abstract] OR "natural language"[Title/Abstract] OR GPT[Title/Abstract] OR CLIP[Title/Abstract] OR "cross-modal"[Title/Abstract] OR multimodal[Title/Abstract] OR "multi-modal"[Title/Abstract] OR tokenization[Title/Abstract] OR "gene token"[Title/Abstract] OR prompt[Title/Abstract] OR "text generation"[Title/Abstract] OR "cell-to-text"[Title/Abstract] OR "text-to-cell"[Title/Abstract] OR NLP[Title/Abstract]) AND ("foundation model"[Title/Abstract] OR pretrained[Title/Abstract] OR "pre-trained"[Title/Abstract] OR "self-supervised"[Title/Abstract] OR transformer[Title/Abstract] OR generative[Title/Abstract] OR decoder[Title/Abstract] OR autoregressive[Title/Abstract] OR "transfer learning"[Title/Abstract] OR "zero-shot"[Title/Abstract] OR "few-shot"[Title/Abstract] OR "masked modeling"[Title/Abstract] OR "attention mechanism"[Title/Abstract] OR "deep learning"[Title/Abstract])) AND ("2018/01/01"[Date - Publication] : "2026/02/28"[Date - Publication]) AND "free full text"[sb] AND English[Language]',
    },
    "scopus": {
        "main": 'TITLE-ABS-KEY(("single cell" OR "single-cell" OR scRNA-seq OR "RNA-seq" OR "RNA seq" OR "gene expression" OR scATAC-seq OR "ATAC-seq" OR "chromatin accessibility" OR CITE-seq OR "spatial transcriptomics" OR "multi-omics" OR "multi omics" OR multiomics OR transcriptomics OR genomics OR proteomics OR epigenomics OR "cell type" OR "gene regulatory") AND ("language model" OR LLM OR "large language model" OR "natural language" OR GPT OR CLIP OR "cross-modal" OR multimodal OR "multi-modal" OR tokeniz* OR "gene token" OR prompt OR "text generation" OR "cell-to-text" OR "text-to-cell" OR NLP) AND ("foundation model" OR pretrain* OR "pre-train*" OR "self-supervised" OR transformer OR generative OR decoder OR autoregressive OR "transfer learning" OR "zero-shot" OR "few-shot" OR "masked modeling" OR "attention mechanism" OR "deep learning")) AND PUBYEAR > 2017 AND OPENACCESS(1) AND LANGUAGE(English)',
    },
    "semantic_scholar": {
        "main": '("single-cell" | "single cell" | "scRNA-seq" | "RNA-seq" | "RNA seq" | "gene expression" | transcriptomics | genomics | proteomics | epigenomics | "spatial transcriptomics" | "multi-omics" | "multi omics") + ("language model" | LLM | "large language model" | "natural language" | GPT | CLIP | multimodal | "multi-modal" | "cross-modal" | tokeniz* | prompt | NLP | "text generation") + ("foundation model" | pretrain* | "self-supervised" | transformer | generative | decoder | autoregressive | "transfer learning" | "zero-shot" | "deep learning")',
        "model_names": '(scGPT | tGPT | LangCell | ChatCell | CellWhisperer | GenePT | GeneGPT | CellPLM | Nicheformer | EpiAgent | PathOmCLIP)',
    },
    "arxiv": {
        "primary": '((ti:"single cell" OR ti:scRNA OR ti:"gene expression" OR ti:transcriptomics OR ti:genomics OR abs:"single-cell" OR abs:"RNA-seq" OR abs:"RNA seq" OR abs:"spatial transcriptomics" OR abs:"multi-omics" OR abs:"multi omics") AND (ti:"language model" OR ti:GPT OR ti:LLM OR ti:CLIP OR ti:multimodal OR abs:"language model" OR abs:"large language model" OR abs:"natural language" OR abs:"cross-modal" OR abs:"multi-modal" OR abs:tokeniz OR abs:prompt) AND (abs:"foundation model" OR abs:pretrain OR abs:"self-supervised" OR abs:transformer OR abs:generative OR abs:decoder OR abs:autoregressive OR abs:"transfer learning")) AND (cat:cs.LG OR cat:cs.AI OR cat:cs.CL OR cat:q-bio.GN OR cat:q-bio.QM OR cat:stat.ML) AND submittedDate:[20180101 TO 20260228]',
        "cell_language": '(abs:"foundation model" AND abs:"single cell" AND abs:"language model") AND (cat:cs.LG OR cat:cs.AI OR cat:cs.CL OR cat:q-bio.GN OR cat:q-bio.QM OR cat:stat.ML) AND submittedDate:[20180101 TO 20260228]',
        "model_names": '((ti:scGPT OR ti:tGPT OR ti:LangCell OR ti:ChatCell OR ti:GenePT OR ti:GeneGPT OR ti:CellPLM OR ti:Nicheformer OR ti:EpiAgent)) AND (cat:cs.LG OR cat:cs.AI OR cat:cs.CL OR cat:q-bio.GN OR cat:q-bio.QM OR cat:stat.ML) AND submittedDate:[20180101 TO 20260228]',
        "bio_llm": '(abs:"gene expression" AND abs:LLM AND (abs:generative OR abs:decoder OR abs:autoregressive)) AND (cat:cs.LG OR cat:cs.AI OR cat:cs.CL OR cat:q-bio.GN OR cat:q-bio.QM OR cat:stat.ML) AND submittedDate:[20180101 TO 20260228]',
    },
    "europepmc": {
        "main": '("single-cell" OR "single cell" OR "scRNA-seq" OR "RNA-seq" OR "RNA seq" OR "gene expression" OR "scATAC-seq" OR "ATAC-seq" OR "chromatin accessibility" OR "CITE-seq" OR "spatial transcriptomics" OR "multi-omics" OR "multi omics" OR transcriptomics OR genomics OR proteomics OR epigenomics) AND ("language model" OR LLM OR "large language model" OR "natural language" OR GPT OR CLIP OR "cross-modal" OR multimodal OR "multi-modal" OR tokeniz* OR "gene token" OR prompt OR "text generation" OR NLP) AND ("foundation model" OR pretrain* OR "self-supervised" OR transformer OR generative OR decoder OR autoregressive OR "transfer learning" OR "zero-shot" OR "few-shot" OR "deep learning") AND (SRC:PPR) AND FIRST_PDATE:[2018-01-01 TO 2026-02-28]',
    },
    "springernature": {
        "main": '(("single-cell" OR "single cell" OR scRNA-seq OR "RNA-seq" OR "RNA seq" OR "gene expression" OR scATAC-seq OR "ATAC-seq" OR "chromatin accessibility" OR CITE-seq OR "spatial transcriptomics" OR "multi-omics" OR "multi omics" OR multiomics OR transcriptomics OR genomics OR proteomics OR epigenomics OR "cell type" OR "gene regulatory") AND ("language model" OR LLM OR "large language model" OR "natural language" OR GPT OR CLIP OR "cross-modal" OR multimodal OR "multi-modal" OR tokenization OR "gene token" OR prompt OR "text generation" OR NLP) AND ("foundation model" OR pretrained OR "pre-trained" OR "self-supervised" OR transformer OR generative OR decoder OR autoregressive OR "transfer learning" OR "zero-shot" OR "few-shot" OR "masked modeling" OR "attention mechanism" OR "deep learning")) AND datefrom:2018-01-01 dateto:2026-02-28',
    },
    "google_scholar": {
        "gs_q1": '"foundation model" "gene expression" "language model" single-cell',
        "gs_q2": 'GPT "single cell" "gene expression" generative',
        "gs_q3": '"natural language" "single-cell" "cell type" foundation model',
        "gs_q4": 'multimodal LLM genomics transcriptomics "foundation model"',
        "gs_q5": 'scGPT OR tGPT OR LangCell OR ChatCell OR CellWhisperer OR GenePT OR GeneGPT OR CellPLM OR Nicheformer OR EpiAgent',
        "gs_q6": '"multi omics" "language model" "foundation model" transformer',
        "gs_q7": '"RNA seq" LLM "foundation model" generative single-cell',
    },
}
