"""Brute force versions."""
import hashlib, math, re, zlib
from collections import Counter, defaultdict
def comps(ids, links):
    root={i:i for i in ids}
    def f(x):
        while root[x]!=x: root[x]=root[root[x]]; x=root[x]
        return x
    for a,b in links:
        a,b=f(a),f(b)
        if a!=b: root[max(a,b)]=min(a,b)
    return {i:f(i) for i in ids}
W=re.compile(r"[^\x20\x09-\x0D]+")
def words(t): return W.findall("".join(chr(ord(c)+32) if 'A'<=c<='Z' else c for c in (t or "")))
def near(rows,k=4):
    S={}
    for i,t in rows:
        w=words(t); S[i]={tuple(w[j:j+k]) for j in range(len(w)-k+1)} if len(w)>=k else ({tuple(w)} if w else set())
    inv=defaultdict(list)
    for i,s in S.items():
        for x in s: inv[x].append(i)
    c=Counter()
    for l in inv.values():
        for a in range(len(l)):
            for b in range(a): c[(l[b],l[a])]+=1
    links=[p for p,n in c.items() if 100*n>=80*(len(S[p[0]])+len(S[p[1]])-n)]
    cc=comps(S,links)
    return {i:(len(S[i]),cc[i],cc[i]==i) for i in S}
def repeats(rows,L=400):
    c=Counter()
    raw={i:(t or "").encode() for i,t in rows}
    for b in raw.values():
        for p in range(len(b)-L+1): c[hash(b[p:p+L])]+=1
    out={}
    for i,b in raw.items():
        cov=bytearray(len(b)+1)
        end=0
        for p in range(len(b)-L+1):
            if c[hash(b[p:p+L])]>1:
                s=max(p,end); cov[s:p+L]=b"\1"*(p+L-s); end=p+L
        runs=sum(1 for j in range(len(b)) if cov[j] and (j==0 or not cov[j-1]))
        kept=bytes(x for j,x in enumerate(b) if not cov[j])
        out[i]=(len(b),len(b)-len(kept),runs,hashlib.sha256(kept).hexdigest())
    return out


def awkward():
    """Null ids and texts, blanks, repeats, ties, a long text."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    shared = " ".join(f"common{i}" for i in range(120))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, shared), (4, shared), (5, shared + " tail"), (6, long), (None, shared),
        (None, None), (7, "one"), (8, "one"), (9, "é世\U0001f600 " * 60), (10, "a" * 3000), (11, "no two three"),
    ]
