"""What the fixture tree must give, read off its files."""

#: kind, stable id, name, file, first and last line
NODES = [
    ('dependency', 'Cargo.toml:cargo:dependency:proptest', 'proptest', 'Cargo.toml', 9, 9),
    ('dependency', 'Cargo.toml:cargo:dependency:serde', 'serde', 'Cargo.toml', 5, 5),
    ('dependency', 'Cargo.toml:cargo:dependency:tokio', 'tokio', 'Cargo.toml', 6, 6),
    ('function', 'app/main.py:function:inner', 'inner', 'app/main.py', 11, 12),
    ('function', 'app/main.py:function:main', 'main', 'app/main.py', 10, 14),
    ('function', 'app/main.py:function:run', 'run', 'app/main.py', 6, 7),
    ('dependency', 'app/main.py:import:8acf464cfd6923ddcae23bab9f570ffde0d7576e1f1b23d82e9afcc7b477ca09', '.store', 'app/main.py', 2, 2),
    ('struct', 'app/main.py:struct:Runner', 'Runner', 'app/main.py', 5, 7),
    ('function', 'app/store.py:function:load', 'load', 'app/store.py', 1, 2),
    ('dependency', 'contracts/Vault.sol:import:8748b1cbfeb4f54eafaca9e04fe737718093083b2756c6899ee4fe849db4797f', './Base.sol', 'contracts/Vault.sol', 2, 2),
    ('function', 'contracts/Vault.sol:solidity:constructor:constructor', 'constructor', 'contracts/Vault.sol', 11, 11),
    ('struct', 'contracts/Vault.sol:solidity:contract:Vault', 'Vault', 'contracts/Vault.sol', 4, 19),
    ('concept', 'contracts/Vault.sol:solidity:event:Paid', 'Paid', 'contracts/Vault.sol', 5, 5),
    ('function', 'contracts/Vault.sol:solidity:function:check', 'check', 'contracts/Vault.sol', 18, 18),
    ('function', 'contracts/Vault.sol:solidity:function:pay', 'pay', 'contracts/Vault.sol', 13, 16),
    ('concept', 'contracts/Vault.sol:solidity:modifier:onlyOwner', 'onlyOwner', 'contracts/Vault.sol', 7, 9),
    ('file', 'file:Cargo.toml', 'Cargo.toml', 'Cargo.toml', 1, 9),
    ('file', 'file:app/broken.py', 'app/broken.py', 'app/broken.py', 1, 1),
    ('file', 'file:app/main.py', 'app/main.py', 'app/main.py', 1, 14),
    ('file', 'file:app/store.py', 'app/store.py', 'app/store.py', 1, 2),
    ('file', 'file:contracts/Vault.sol', 'contracts/Vault.sol', 'contracts/Vault.sol', 1, 19),
    ('file', 'file:docs/guide.md', 'docs/guide.md', 'docs/guide.md', 1, 3),
    ('file', 'file:infra/cdk.json', 'infra/cdk.json', 'infra/cdk.json', 1, 3),
    ('file', 'file:infra/stack.ts', 'infra/stack.ts', 'infra/stack.ts', 1, 11),
    ('file', 'file:src/lib.rs', 'src/lib.rs', 'src/lib.rs', 1, 29),
    ('file', 'file:web/app.ts', 'web/app.ts', 'web/app.ts', 1, 29),
    ('file', 'file:web/package.json', 'web/package.json', 'web/package.json', 1, 5),
    ('file', 'file:web/tsconfig.json', 'web/tsconfig.json', 'web/tsconfig.json', 1, 1),
    ('dependency', 'import:bare:@acme/web/kit', '@acme/web/kit', None, None, None),
    ('dependency', 'import:bare:os', 'os', None, None, None),
    ('deployment_resource', 'infra/cdk.json:aws-cdk:app', 'AWS CDK app', 'infra/cdk.json', 2, 3),
    ('deployment_resource', 'infra/stack.ts:aws-cdk:resource:lambda.Function:Handler', 'lambda.Function Handler', 'infra/stack.ts', 7, 9),
    ('deployment_resource', 'infra/stack.ts:aws-cdk:stack:LedgerStack', 'LedgerStack', 'infra/stack.ts', 4, 11),
    ('function', 'infra/stack.ts:function:constructor', 'constructor', 'infra/stack.ts', 5, 10),
    ('struct', 'infra/stack.ts:struct:LedgerStack', 'LedgerStack', 'infra/stack.ts', 4, 11),
    ('repository', 'repo', 'ledger', None, None, None),
    ('concept', 'solidity:inheritance:Base', 'Base', None, None, None),
    ('concept', 'solidity:inheritance:Ownable', 'Ownable', None, None, None),
    ('function', 'src/lib.rs:function:helper', 'helper', 'src/lib.rs', 22, 24),
    ('function', 'src/lib.rs:function:total', 'total', 'src/lib.rs', 17, 18),
    ('impl', 'src/lib.rs:impl:Clone for Ledger', 'Clone for Ledger', 'src/lib.rs', 11, 15),
    ('impl', 'src/lib.rs:impl:Ledger', 'Ledger', 'src/lib.rs', 7, 9),
    ('struct', 'src/lib.rs:struct:Ledger', 'Ledger', 'src/lib.rs', 3, 5),
    ('test', 'src/lib.rs:test:adds', 'adds', 'src/lib.rs', 27, 29),
    ('concept', 'src/lib.rs:use:ece3053e8347c36af561bfee6efb8a37b110a2e2276eab6841622fbe97d17459', 'use std::collections::HashMap, HashSet as Set', 'src/lib.rs', None, None),
    ('enum', 'web/app.ts:enum:Mode', 'Mode', 'web/app.ts', 11, 13),
    ('function', 'web/app.ts:function:constructor', 'constructor', 'web/app.ts', 24, 24),
    ('function', 'web/app.ts:function:draw', 'draw', 'web/app.ts', 26, 28),
    ('function', 'web/app.ts:function:render', 'render', 'web/app.ts', 19, 21),
    ('function', 'web/app.ts:function:start', 'start', 'web/app.ts', 15, 17),
    ('dependency', 'web/app.ts:import:dc2ae57182a2165d84818ad8c19a3fcba4c5de0be80ca2d2279f90d113c2d67e', './style', 'web/app.ts', 3, 3),
    ('struct', 'web/app.ts:struct:View', 'View', 'web/app.ts', 23, 29),
    ('trait', 'web/app.ts:trait:Props', 'Props', 'web/app.ts', 5, 7),
    ('type_alias', 'web/app.ts:type_alias:Id', 'Id', 'web/app.ts', 9, 9),
    ('dependency', 'web/package.json:npm:dependency:@acme/kit', '@acme/kit', 'web/package.json', 3, 3),
    ('dependency', 'web/package.json:npm:dependency:react', 'react', 'web/package.json', 3, 3),
    ('script', 'web/package.json:npm:script:build', 'npm script build', 'web/package.json', 4, 4),
]
#: kind, from, to, cost, confidence
EDGES = [
    ('calls', 'app/main.py:function:inner', 'app/main.py:struct:Runner', 0.35, 0.7),
    ('calls', 'app/main.py:function:main', 'app/main.py:function:inner', 0.35, 0.7),
    ('calls', 'app/main.py:function:run', 'app/store.py:function:load', 0.35, 0.7),
    ('implements', 'contracts/Vault.sol:solidity:contract:Vault', 'solidity:inheritance:Base', 0.2, 0.95),
    ('implements', 'contracts/Vault.sol:solidity:contract:Vault', 'solidity:inheritance:Ownable', 0.2, 0.95),
    ('calls', 'contracts/Vault.sol:solidity:function:pay', 'contracts/Vault.sol:solidity:event:Paid', 0.35, 0.7),
    ('calls', 'contracts/Vault.sol:solidity:function:pay', 'contracts/Vault.sol:solidity:function:check', 0.35, 0.7),
    ('depends_on', 'file:Cargo.toml', 'Cargo.toml:cargo:dependency:proptest', 0.2, 1.0),
    ('depends_on', 'file:Cargo.toml', 'Cargo.toml:cargo:dependency:serde', 0.2, 1.0),
    ('depends_on', 'file:Cargo.toml', 'Cargo.toml:cargo:dependency:tokio', 0.2, 1.0),
    ('contains', 'file:app/main.py', 'app/main.py:function:inner', 0.1, 1.0),
    ('contains', 'file:app/main.py', 'app/main.py:function:main', 0.1, 1.0),
    ('contains', 'file:app/main.py', 'app/main.py:function:run', 0.1, 1.0),
    ('imports', 'file:app/main.py', 'app/main.py:import:8acf464cfd6923ddcae23bab9f570ffde0d7576e1f1b23d82e9afcc7b477ca09', 0.35, 1.0),
    ('contains', 'file:app/main.py', 'app/main.py:struct:Runner', 0.1, 1.0),
    ('imports', 'file:app/main.py', 'import:bare:os', 0.35, 1.0),
    ('contains', 'file:app/store.py', 'app/store.py:function:load', 0.1, 1.0),
    ('imports', 'file:contracts/Vault.sol', 'contracts/Vault.sol:import:8748b1cbfeb4f54eafaca9e04fe737718093083b2756c6899ee4fe849db4797f', 0.3, 1.0),
    ('contains', 'file:contracts/Vault.sol', 'contracts/Vault.sol:solidity:constructor:constructor', 0.1, 1.0),
    ('defines', 'file:contracts/Vault.sol', 'contracts/Vault.sol:solidity:contract:Vault', 0.08, 1.0),
    ('contains', 'file:contracts/Vault.sol', 'contracts/Vault.sol:solidity:event:Paid', 0.1, 1.0),
    ('contains', 'file:contracts/Vault.sol', 'contracts/Vault.sol:solidity:function:check', 0.1, 1.0),
    ('contains', 'file:contracts/Vault.sol', 'contracts/Vault.sol:solidity:function:pay', 0.1, 1.0),
    ('contains', 'file:contracts/Vault.sol', 'contracts/Vault.sol:solidity:modifier:onlyOwner', 0.1, 1.0),
    ('configures', 'file:infra/cdk.json', 'infra/cdk.json:aws-cdk:app', 0.15, 1.0),
    ('configures', 'file:infra/stack.ts', 'infra/stack.ts:aws-cdk:resource:lambda.Function:Handler', 0.12, 0.95),
    ('defines', 'file:infra/stack.ts', 'infra/stack.ts:aws-cdk:stack:LedgerStack', 0.08, 1.0),
    ('contains', 'file:infra/stack.ts', 'infra/stack.ts:function:constructor', 0.1, 1.0),
    ('contains', 'file:infra/stack.ts', 'infra/stack.ts:struct:LedgerStack', 0.1, 1.0),
    ('contains', 'file:src/lib.rs', 'src/lib.rs:function:helper', 0.1, 1.0),
    ('contains', 'file:src/lib.rs', 'src/lib.rs:function:total', 0.1, 1.0),
    ('contains', 'file:src/lib.rs', 'src/lib.rs:impl:Clone for Ledger', 0.1, 1.0),
    ('contains', 'file:src/lib.rs', 'src/lib.rs:impl:Ledger', 0.1, 1.0),
    ('contains', 'file:src/lib.rs', 'src/lib.rs:struct:Ledger', 0.1, 1.0),
    ('contains', 'file:src/lib.rs', 'src/lib.rs:test:adds', 0.1, 1.0),
    ('imports', 'file:src/lib.rs', 'src/lib.rs:use:ece3053e8347c36af561bfee6efb8a37b110a2e2276eab6841622fbe97d17459', 0.4, 0.8),
    ('imports', 'file:web/app.ts', 'import:bare:@acme/web/kit', 0.35, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:enum:Mode', 0.1, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:function:constructor', 0.1, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:function:draw', 0.1, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:function:render', 0.1, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:function:start', 0.1, 1.0),
    ('imports', 'file:web/app.ts', 'web/app.ts:import:dc2ae57182a2165d84818ad8c19a3fcba4c5de0be80ca2d2279f90d113c2d67e', 0.35, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:struct:View', 0.1, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:trait:Props', 0.1, 1.0),
    ('contains', 'file:web/app.ts', 'web/app.ts:type_alias:Id', 0.1, 1.0),
    ('depends_on', 'file:web/package.json', 'web/package.json:npm:dependency:@acme/kit', 0.2, 1.0),
    ('depends_on', 'file:web/package.json', 'web/package.json:npm:dependency:react', 0.2, 1.0),
    ('defines', 'file:web/package.json', 'web/package.json:npm:script:build', 0.25, 1.0),
    ('contains', 'repo', 'file:Cargo.toml', 0.1, 1.0),
    ('contains', 'repo', 'file:app/broken.py', 0.1, 1.0),
    ('contains', 'repo', 'file:app/main.py', 0.1, 1.0),
    ('contains', 'repo', 'file:app/store.py', 0.1, 1.0),
    ('contains', 'repo', 'file:contracts/Vault.sol', 0.1, 1.0),
    ('contains', 'repo', 'file:docs/guide.md', 0.45, 0.8),
    ('contains', 'repo', 'file:infra/cdk.json', 0.1, 1.0),
    ('contains', 'repo', 'file:infra/stack.ts', 0.1, 1.0),
    ('contains', 'repo', 'file:src/lib.rs', 0.1, 1.0),
    ('contains', 'repo', 'file:web/app.ts', 0.1, 1.0),
    ('contains', 'repo', 'file:web/package.json', 0.1, 1.0),
    ('contains', 'repo', 'file:web/tsconfig.json', 0.1, 1.0),
    ('calls', 'src/lib.rs:test:adds', 'src/lib.rs:function:total', 0.35, 0.7),
    ('calls', 'web/app.ts:function:draw', 'web/app.ts:function:start', 0.35, 0.7),
    ('calls', 'web/app.ts:function:render', 'web/app.ts:function:draw', 0.35, 0.7),
    ('calls', 'web/app.ts:function:start', 'web/app.ts:function:render', 0.35, 0.7),
]
#: type, file, first and last line, SHA-256 of the text
CHUNKS = [
    ('dependency', 'Cargo.toml', 5, 5, 'a221f2fab40b48ae0a1885ced09d5cdff558c5b76b67d2d00eee4c3c2f394275'),
    ('dependency', 'Cargo.toml', 6, 6, '53e4f6a855959d4f6a140c2b56219dd821dcfad57a775117734a01c8ebb18e4b'),
    ('dependency', 'Cargo.toml', 9, 9, '0deaffc1d9f7d7a9d1c8662958a4b49679c46ef15d20102833495c79e05eeebd'),
    ('struct', 'app/main.py', 5, 7, '62e0665a3766b69798a4998b9a3b4998cfe57df5c8a5a07786f6f6e9791beeea'),
    ('function', 'app/main.py', 6, 7, '3804a3ff2f2dd1b54917bec5fa66e5ac3bb896afa72440ff33bfb2ccf95e2913'),
    ('function', 'app/main.py', 10, 14, 'ea508f8d8079ecf3780d6ac1a8a65ef51cfdfae1aa44e3093c13ae3f7e73d017'),
    ('function', 'app/main.py', 11, 12, '079e528a1839d5f1277d6b53bf4b29b479066711f2971a7517763ed442dd6370'),
    ('function', 'app/store.py', 1, 2, '88c347e567dff0c10cf53ac3404a473c8869910690b720b9ae34758a3d48d598'),
    ('struct', 'contracts/Vault.sol', 4, 19, '905256f42eb2b64411e8cdce972d6fddb2a2f297727a1c9c6424facdceedd18d'),
    ('concept', 'contracts/Vault.sol', 5, 5, '670f6dd6ef72e78b55232e6f17e7a9a55c162df7a4d6938187da421693ad1107'),
    ('concept', 'contracts/Vault.sol', 7, 9, '33152d0b09f6a67bc5e80296e5f0af5370cbb7bdb1488afca20f67889f228319'),
    ('function', 'contracts/Vault.sol', 11, 11, '9177127e27e64ef33b69ccbecbe902b62c673dc7e78b3b38d9a8e4a90f2aa1b3'),
    ('function', 'contracts/Vault.sol', 13, 16, '277d20deee7e721bc9e4dd434d56945b0fc16453fb79738c499143aeb7f19a9f'),
    ('function', 'contracts/Vault.sol', 18, 18, '57e32954ba4b45cf99c15bc3f02ecec11463bf7e127f930f2cdfd9fce8ae14ef'),
    ('documentation', 'docs/guide.md', 1, 3, '81626062f81b647dd72c827765bf32dae04a19d71290165ff42d50616aa127b1'),
    ('aws_cdk_app', 'infra/cdk.json', 2, 3, 'f71a4a65bce53d460d948c8e7e2c0ce805783a8d60692c7eac0d60865e82270d'),
    ('aws_cdk_stack', 'infra/stack.ts', 4, 11, '0c0af0f8fa34f236b6b005875b0cc669ecf6b7932d701af272ed392d47723b10'),
    ('struct', 'infra/stack.ts', 4, 11, '310ed1c8f0271943072fd36767e41728668f95987a7715548ff0a7a7f54b9d12'),
    ('function', 'infra/stack.ts', 5, 10, 'ddcf0402e6c588ade8f8305767d4b5f648183cf57e9a6aec6e18855d597b9c1e'),
    ('aws_cdk_resource', 'infra/stack.ts', 7, 9, '5f6937d91e8771e956dfc9f17bfdfc55a1727ae9debc3301c580c3aac437ceb3'),
    ('struct', 'src/lib.rs', 3, 5, '09f7bdbb511eb3033ad0923db58ded555f844e4e624530d2664f3247a6829279'),
    ('impl', 'src/lib.rs', 7, 9, 'df9e691a436809dc2727bbae28d659cb41ba61291ba46ddc563284a3e8229e7f'),
    ('impl', 'src/lib.rs', 11, 15, '7be75d4f363d03c07407f0c75618be561d4777085a273e5b83821aae947d51f3'),
    ('function', 'src/lib.rs', 17, 18, '7d044a4ebd186c8de254a8b39fb30270f0bd0c45b7113f0c951fca4a1d464a63'),
    ('function', 'src/lib.rs', 22, 24, '720a531f573133c81c8324d3bbf7f6d95811cd7da5ca8f47ad7953edb47a8e8b'),
    ('test', 'src/lib.rs', 27, 29, 'f6c4df8df3c286b2142b33de45f7d45bc8728665f76b1549a4b3785eca16a3e4'),
    ('trait', 'web/app.ts', 5, 7, '3d4beabe5a3b7d44ef502df2a22917b6ed52006c05fb8d72a86683967fb246ce'),
    ('type_alias', 'web/app.ts', 9, 9, '03ae4cc3f0fb210b13c9923f2b5c6bc7059dd2d82c797edea31d32b75ce074ee'),
    ('enum', 'web/app.ts', 11, 13, '21dde36554fd4d304dc11523d95922365b4100dd1ad2abc1f4503bcdce139e1c'),
    ('function', 'web/app.ts', 15, 17, 'afcfa2979e1e113947f2c7b8eb376d080e86ad188acdf07bc19f9ca9955b0b95'),
    ('function', 'web/app.ts', 19, 21, '620a97200871a04d2bcf77b651f0770dd6b7b76e624803893b2dd7b098058b72'),
    ('struct', 'web/app.ts', 23, 29, '3b34241d3680391ed4846a969bd9f018ea1676715c01965310dbc71da984c723'),
    ('function', 'web/app.ts', 24, 24, '9e305bc10c0c3521407e89303aa86a68a2a92b09391bb22a851565a8ce854aca'),
    ('function', 'web/app.ts', 26, 28, '1baa8322670ce813cc102167c51b67430eef045e8ea685b68b6bb8faa2e3d1ef'),
    ('dependency', 'web/package.json', None, None, '82ee33f0d082ef30ef7f8efda87367153157794a4456dec1b82422ef31685f03'),
    ('script', 'web/package.json', None, None, 'aa0722251bd0cb5148ce16a77359e9b25d2b197d49ce2cad2ba0db1db1aaed40'),
    ('config', 'web/tsconfig.json', 1, 1, '49c9307e9768f2c44ba08f23d63906856f75709f34b8db025b8e7f07d1c61eac'),
]
